"""Secret scans over a trigram inverted index, in SQL expressions only.

Each rule's regular expression gives a Boolean query over trigrams that any match must
hold: an OR of ANDs (alternatives of mandatory literals).  The index lists, for each
trigram that some query names, the documents that hold it; a rule's candidates are the
documents in the intersection of its postings, and only these are searched with the
expression.  Rules without mandatory trigrams search every document.

The candidates are stored, and a filter of fixed size tells in the scan which documents
can be among them: only those texts are shuffled to meet their candidate's row.  From some
ten million candidates on the filter lets more and more others through, at last all; the
join alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.store import come_back, materialize, row_uid, stand_aside


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed kinds of the scan, in their order of listing, then kinds of our own.  Runs that
#: are maximal carry their least length in the expression: most texts then fail at once.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 16),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 3),
    Rule("hook", r"hooks\.[a-z]+\.com/services/([A-Za-z0-9/_-]+)", 1, 20),
)
RULES = BASE_RULES + MORE_RULES


# -- Boolean trigram queries -------------------------------------------------

Query = frozenset  # OR of frozensets of trigrams; an empty frozenset within: no condition
ANY: Query = frozenset([frozenset()])
#: Literals of a part that are spelled out; wider parts carry no condition.
MOST_LITERALS = 24


def _literals(items) -> list[str] | None:
    """All strings that a fixed part can be (lower case), or None where they are too many."""
    out = [""]
    for kind, arg in items:
        if kind is op.LITERAL:
            more = [chr(arg).lower()]
        elif kind is op.IN and len(arg) == 1 and arg[0][0] is op.LITERAL:
            more = [chr(arg[0][1]).lower()]
        elif kind is op.SUBPATTERN:
            more = _literals(arg[3])
        elif kind is op.BRANCH:
            parts = [_literals(x) for x in arg[1]]
            more = None if any(p is None for p in parts) else [y for p in parts for y in p]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] != op.MAXREPEAT and arg[1] <= 2:
            once = _literals(arg[2])
            more = None if once is None else sorted({x * n for x in once for n in range(arg[0], arg[1] + 1)})
        else:
            more = None
        if more is None or len(out) * len(more) > MOST_LITERALS:
            return None
        out = [x + y for x in out for y in more]
    return out


def trigram_query(pattern: str) -> Query:
    """OR of ANDs of (lower-case) trigrams that every match of ``pattern`` holds; ANY if there are none.

    The longest runs of fixed parts are spelled out, each run gives an OR over its
    spellings, and the most selective run is used.
    """
    runs, run = [], []
    for item in [*_flat(_parser.parse(pattern)), None]:
        if item is not None and _literals([item]) is not None:
            run.append(item)
            if _literals(run) is None:
                runs.append(run[:-1])
                run = [item]
        else:
            runs.append(run)
            run = []
    best, most = ANY, 0
    for run in runs:
        spelled = _literals(run) if run else None
        if spelled and min(map(len, spelled)) >= 3:
            query = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spelled)
            if min(map(len, query)) > most:
                best, most = query, min(map(len, query))
    return best


def _flat(items) -> list:
    """Items with groups that aren't optional opened."""
    out = []
    for kind, arg in items:
        if kind is op.SUBPATTERN and _literals([(kind, arg)]) is None:
            out += _flat(arg[3])
        else:
            out.append((kind, arg))
    return out


def postings(docs: DataFrame, trigrams: list[str], uid: str = "__uid", text: str = "__text") -> DataFrame:
    """The inverted index: a row (trigram, uid) for each of ``trigrams`` that a document holds, in any case of letters."""
    lower = F.lower(F.col(text))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("__lower"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(uid, lower.alias("__lower")).select(uid, F.explode_outer(held).alias("trigram")).filter("trigram is not null")


def candidates(index: DataFrame, queries: list[Query], uid: str = "__uid") -> DataFrame:
    """(uid, __rules): bit k of ``__rules`` is set for documents in the intersected postings of query k."""
    names = sorted({t for q in queries for part in q for t in part})
    bit = {t: i for i, t in enumerate(names)}
    words = -(-len(names) // 60)
    zero = F.lit(0).cast("long")

    def mask(w: int) -> Column:
        own = [(t, 1 << i % 60) for t, i in bit.items() if i // 60 == w]
        table = F.create_map(*[x for t, m in own for x in (F.lit(t), F.lit(m).cast("long"))])
        return F.bit_or(F.coalesce(F.try_element_at(table, F.col("trigram")), zero)).alias(f"m{w}")

    masks = [mask(w) for w in range(words)]
    held = index.groupBy(uid).agg(*masks)

    def meets(part: frozenset) -> Column:
        out = F.lit(True)
        for w in range(words):
            need = sum(1 << bit[t] % 60 for t in part if bit[t] // 60 == w)
            if need:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
        return out

    rules = F.lit(0)
    for k, q in enumerate(queries):
        either = F.lit(False)
        for part in sorted(q, key=sorted):
            either = either | meets(part)
        rules = rules + F.when(either, F.lit(1 << k)).otherwise(F.lit(0))
    return held.select(uid, rules.alias("__rules")).filter("__rules <> 0")


# -- Verification ------------------------------------------------------------


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(rule: Rule, order: int, text: str = "__text") -> Column:
    """Array of (start, order, kind, end) of the rule's matches: leftmost, without overlap, code points, end exclusive.

    The texts between matches and the matches' lengths give the places; SQL has no
    function that returns them all.
    """
    pattern = _sql(rule.pattern)
    whole = f"regexp_extract_all({text}, {pattern}, 0)"
    parts = f"split({text}, {pattern}, -1)"
    # the part before match i begins at the sum of all earlier parts and matches
    return F.expr(
        f"""if(not rlike({text}, {pattern}), cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>),
        filter(transform(
          aggregate(
            zip_with(zip_with({whole}, {parts}, (m, p) -> struct(m, p)), regexp_extract_all({text}, {pattern}, {rule.group}), (x, g) -> named_struct('m', x.m, 'p', x.p, 'g', g)),
            named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,size:int>>)),
            (acc, x) -> if(x.m is null, acc, named_struct(
              'at', acc.at + char_length(x.p) + char_length(x.m),
              'out', array_append(acc.out, named_struct('start', acc.at + char_length(x.p), 'end', acc.at + char_length(x.p) + char_length(x.m), 'size', char_length(x.g))))),
            acc -> acc.out),
          s -> named_struct('start', s.start, 'ord', {order}, 'kind', if(s.size >= {rule.least}, '{rule.kind}', null), 'end', s.end)),
          s -> s.kind is not null))"""
    )


#: Longs of the filter over candidates: 2 MB, whatever the data.
FILTER_LONGS = 1 << 18


def uid_filter(ids: DataFrame, uid: str = "__uid", longs: int = FILTER_LONGS) -> Column:
    """One-hash filter over ``uid``, as a scalar: an array of ``longs`` bit sets."""
    slot = f"pmod({uid}, {64 * longs})"
    seen = ids.select(F.expr(f"cast({slot} div 64 as int) as w"), F.expr(f"shiftleft(1L, cast({slot} % 64 as int)) as m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    every = ids.sparkSession.range(longs).select(F.col("id").cast("int").alias("w")).join(seen, "w", "left").na.fill(0, ["m"])
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("bits")).scalar()


def in_filter(bits: str = "__bits", uid: str = "__uid", longs: int = FILTER_LONGS) -> Column:
    """Whether the filter in column ``bits`` has ``uid``."""
    slot = f"pmod({uid}, {64 * longs})"
    return F.expr(f"(shiftrightunsigned({bits}[cast({slot} div 64 as int)], cast({slot} % 64 as int)) & 1L) = 1L")


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "found") -> DataFrame:
    """Every row with ``out``: all matches as an array of (start, ord, kind, end), sorted.

    Null text counts as empty: no match; texts of any length are searched whole.  Rows that
    repeat id and text share candidates and give equal results, each its own row; matches
    that begin at one place are in the order of the rules; null ids are kept; a column of
    the input named as ``out`` gives way, all others keep their values, whatever their names; an empty
    table gives no rows.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [k for k, q in enumerate(queries) if q != ANY]
    docs, names = stand_aside(docs, out)
    columns = come_back(names, out)
    rows = docs.withColumn("__text", F.coalesce(F.col(names[text_col]), F.lit(""))).withColumn("__uid", row_uid(names[id_col], names[text_col]))

    def searched(part: DataFrame, asked: bool) -> DataFrame:
        """``part`` with the spans; rules with an index only for rows that are their candidates."""
        spans = []
        for k, rule in enumerate(rules):
            if k not in indexed:
                spans.append(spans_of(rule, k))
            elif asked:
                mine = F.col("__rules").bitwiseAND(F.lit(1 << indexed.index(k))) != 0
                spans.append(F.when(F.col("__rules").isNotNull() & mine, spans_of(rule, k)).otherwise(_no_spans()))
        found = F.array_sort(F.concat(*spans)) if len(spans) > 1 else spans[0] if spans else _no_spans()
        return part.select(*columns, found.alias(out))

    if not indexed:
        return searched(rows, False)
    names = sorted({t for k in indexed for part in queries[k] for t in part})
    # stored: the join below is then of two plain shuffles, in which the partition of a hot text can be split
    hits = materialize(candidates(postings(rows, names), [queries[k] for k in indexed]), "candidates")
    marked = rows.withColumn("__bits", uid_filter(hits))
    maybe = in_filter()
    inside = searched(marked.filter(maybe).drop("__bits").join(hits, "__uid", "left"), True)
    return searched(marked.filter(~maybe), False).unionByName(inside)


def listed(found: str, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the matches, joined by commas."""
    own = f"filter({found}, s -> s.kind in ({', '.join(_sql(k) for k in kinds)}))" if kinds else found
    return F.expr(f"array_join(transform({own}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; overlapping matches become one mark.

    Null texts stay null; rows that repeat a text are changed alike, each its own row; an
    empty table gives no rows; other columns stay as they are, whatever their names.
    """
    docs, names = stand_aside(docs)
    text_col = names[text_col]
    found = scan_secrets(docs.withColumn("__one", F.lit(1)), rules, "__one", text_col, "__found")
    merged = F.expr(
        """aggregate(__found, cast(array() as array<struct<s:int,e:int>>), (a, x) ->
           if(size(a) > 0 and x.start < a[size(a) - 1].e,
              concat(slice(a, 1, size(a) - 1), array(named_struct('s', a[size(a) - 1].s, 'e', greatest(a[size(a) - 1].e, x.end)))),
              array_append(a, named_struct('s', x.start, 'e', x.end))))"""
    )
    cut = f"""concat(array_join(transform(__spans, (x, i) -> concat(
                substring({text_col}, if(i = 0, 0, __spans[i - 1].e) + 1, x.s - if(i = 0, 0, __spans[i - 1].e)), '{mark}')), ''),
              substring({text_col}, __spans[size(__spans) - 1].e + 1))"""
    done = found.withColumn("__spans", merged).withColumn(text_col, F.expr(f"if({text_col} is null or size(__spans) = 0, {text_col}, {cut})"))
    return done.select(*come_back(names))


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = listed("found", ("assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed("found").alias("spans"))
