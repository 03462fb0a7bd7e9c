r"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are assignments, access identifiers and long hexadecimal runs. Weak candidates are 40-character runs (``key``) and
URLs (``endpoint``), each of which alone says nothing; they are reported only when complementary parts lie within a scope of
``SCOPE`` code points: a key beside an access identifier, an endpoint beside both an access identifier and a secret (an assignment
or a reported key). This interval join pairs spans of one text, so it runs inside the row, over arrays, and shuffles nothing.

Positions are code points: the gaps that ``split`` leaves and the matches are measured and added up. Sums and extremes along an array are taken
in pieces of about the square root of its length, and spans meet in one sorted array, so a text with very many matches costs
little more than its matches; a text is cut in pieces before spans are masked.
Defined results: a null text is an empty one and has no span; the digest of no spans is that of the empty string; repeated rows stay;
other columns may have any name: ``scan`` replaces ``base_spans`` and ``all_spans``, ``without_secrets`` keeps all but the text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.shared import documents

SCOPE = 200
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(:[0-9]+)?"
KINDS = ("assign", "access", "hex", "key", "endpoint")
#: Code points of a piece of a text that is masked.
PIECE = 1024
SPANS = "array<struct<start:int,kind:int,end:int>>"


# The functions below make SQL text: higher-order functions that nest this deeply take seconds to build from columns, one call at a time.


def literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, name: str, use: str) -> str:
    """``use``, in which ``name`` is the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def running(values: str, step: str, zero: int) -> str:
    """The array's running sum, maximum or minimum (``step`` of a and b): within pieces of about the square root of its length, then over the pieces' ends."""

    def piece(x: str) -> str:
        more = bound(step.format(a="acc.at", b="v"), "n", "named_struct('at', n, 'out', array_append(acc.out, n))")
        return f"aggregate({x}, named_struct('at', {zero}, 'out', cast(array() as array<int>)), (acc, v) -> {more}).out"

    ends = piece("transform(pieces, p -> element_at(p, -1))")
    shifted = f"flatten(transform(pieces, (p, i) -> transform(p, v -> if(i = 0, v, {step.format(a='get(ends, i - 1)', b='v')}))))"
    begins = bound("cast(ceil(sqrt(size(x))) as int)", "w", f"transform(sequence(1, size(x), w), i -> {piece('slice(x, i, w)')})")
    return bound(values, "x", f"if(size(x) = 0, cast(array() as array<int>), {bound(begins, 'pieces', bound(ends, 'ends', shifted))})")


def matches(text: str, pattern: str, kind: int, keep: str = "true") -> str:
    """Spans of the leftmost matches that do not overlap; ``keep`` (of end, start and part) may drop some."""
    p = literal(pattern)
    # the last gap, after the last match, ends no match
    found = f"named_struct('hits', regexp_extract_all({text}, {p}, 0), 'parts', regexp_extract_all({text}, {p}, {2 if kind == 0 else 0}), 'gaps', transform(split({text}, {p}, -1), g -> length(g)))"
    ends = running("zip_with(slice(m.gaps, 1, size(m.hits)), m.hits, (gap, hit) -> gap + length(hit))", "{a} + {b}", 0)
    rows = f"transform({ends}, (e, i) -> named_struct('start', e - length(get(m.hits, i)), 'kind', {kind}, 'end', e, 'part', get(m.parts, i)))"
    spans = f"transform(filter({rows}, r -> {keep}), r -> named_struct('start', r.start, 'kind', r.kind, 'end', r.end))"
    return f"if({text} rlike {p}, {bound(found, 'm', spans)}, cast(array() as {SPANS}))"


def beside(spans: str, weak: int, others: list[list[int]], scope: int) -> str:
    """The sorted ``spans`` without those of the ``weak`` kind that a base span holds, or that have no span of one of the lists of kinds within ``scope``.

    To the left the furthest end decides, to the right the nearest start, so running extremes answer for all spans at once.
    """
    far = 1 << 30
    kinds = lambda ks: f"s.kind in ({', '.join(map(str, ks))})"
    furthest = lambda ks: running(f"transform(spans, s -> if({kinds(ks)}, s.end, -{far}))", "greatest({a}, {b})", -far)
    nearest = lambda ks: f"reverse({running(f'transform(reverse(spans), s -> if({kinds(ks)}, s.start, {far}))', 'least({a}, {b})', far)})"
    known = "".join(f", 'left{k}', {furthest(ks)}, 'right{k}', {nearest(ks)}" for k, ks in enumerate(others))
    fits = "".join(f" and (get(known.left{k}, i) >= s.start - {scope} or get(known.right{k}, i) <= s.end + {scope})" for k in range(len(others)))
    kept = f"filter(spans, (s, i) -> s.kind <> {weak} or (get(known.base, i) < s.end{fits}))"
    return bound(spans, "spans", bound(f"named_struct('base', {furthest([0, 1, 2])}{known})", "known", kept))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``, arrays of (start, kind, end) sorted by start, then kind. ``text``: SQL for the text."""
    t = f"coalesce({text}, '')"
    found = docs.withColumn("base_spans", F.expr(f"array_sort(concat({matches(t, ASSIGN, 0, 'length(r.part) >= 6')}, {matches(t, ACCESS, 1)}, {matches(t, HEX, 2)}))"))
    keys = beside(f"array_sort(concat(base_spans, {matches(t, KEY, 3, 'r.end - r.start = 40')}))", 3, [[1]], scope)
    urls = beside(f"array_sort(concat({keys}, {matches(t, ENDPOINT, 4)}))", 4, [[1], [0, 3]], scope)
    return found.withColumn("all_spans", F.expr(f"if(exists(base_spans, s -> s.kind = 1), {urls}, base_spans)"))


def written(spans: str) -> Column:
    names = ", ".join(map(literal, KINDS))
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')")


def counted(spans: str, kind: int) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = {kind})) as long)")


def masked(text: str, spans: str, mask: str = "<removed>") -> Column:
    """The text with each span (or run of overlapping spans) replaced by the mask. ``text`` and ``spans``: SQL."""

    def cut(a: str, b: str) -> str:
        i, j = f"({a}) div {PIECE}", f"({b} - 1) div {PIECE}"
        first = f"get(known.pieces, cast({i} as int))"
        within = f"substring({first}, cast({a} - {i} * {PIECE} + 1 as int), {b} - ({a}))"
        across = (
            f"concat(substring({first}, cast({a} - {i} * {PIECE} + 1 as int), {PIECE}), array_join(slice(known.pieces, cast({i} + 2 as int), cast({j} - {i} - 1 as int)), ''), "
            f"substring(get(known.pieces, cast({j} as int)), 1, cast({b} - {j} * {PIECE} as int)))"
        )
        return f"case when {a} >= {b} then '' when {i} = {j} then {within} else {across} end"

    before = "coalesce(get(known.ends, i - 1), 0)"
    parts = f"transform({spans}, (s, i) -> if(s.start >= {before}, concat({cut(before, 's.start')}, {literal(mask)}), ''))"
    last = cut("element_at(known.ends, -1)", f"length({text})")
    pieces = f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"
    ends = running(f"transform({spans}, s -> s.end)", "greatest({a}, {b})", 0)
    made = bound(f"named_struct('pieces', {pieces}, 'ends', {ends})", "known", f"array_join(concat({parts}, array({last})), '')")
    return F.expr(f"if(size({spans}) > 0, {made}, {text})")


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked in its text; n_chars, where there is one, follows."""
    rows = scan(docs.select(F.struct("*").alias("row")), "row.text")
    rows = rows.select("row", F.size("all_spans").alias("n"), masked("row.text", "all_spans").alias("text"))

    def column(name: str) -> Column:
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.when(F.col("n") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return (F.col("text") if name == "text" else own).alias(name)

    return rows.select(*map(column, docs.columns))


def op6_credentials(spark, sf_dir):
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [counted("base_spans", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    found = found.select("doc_id", "base_spans", "all_spans")
    return found.select("doc_id", *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("all_spans").alias("spans"))


def _sql_spans(kind: int, pattern: str, keep: str) -> str:
    """DuckDB: one row per match, with start and end, from the gaps and matches of a text."""
    p, group = pattern.replace("'", "''"), 2 if kind == 0 else 0
    return (
        f"select doc_id, unnest(list_zip(range(1, len(hit) + 1), hit, part)) as h, gap, hit from "
        f"(select doc_id, regexp_extract_all(t, '{p}') as hit, regexp_extract_all(t, '{p}', {group}) as part, string_split_regex(t, '{p}') as gap from t where regexp_matches(t, '{p}'))"
    ), keep


def credentials_sql() -> str:
    """The same over DuckDB: spans as rows, interval join on (doc_id, position)."""
    keeps = ("length(h[3]) >= 6", "true", "true", "length(h[2]) = 40", "true")
    parts = []
    for kind, (pattern, keep) in enumerate(zip((ASSIGN, ACCESS, HEX, KEY, ENDPOINT), keeps)):
        rows, keep = _sql_spans(kind, pattern, keep)
        before = "coalesce(list_sum(list_transform(gap[1:h[1]], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:h[1] - 1], lambda x: length(x))), 0)"
        parts.append(f"select doc_id, {kind} as kind, cast({before} as bigint) as s, cast({before} + length(h[2]) as bigint) as e from ({rows}) where {keep}")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e)"
    near = lambda a, b: f"{a}.doc_id = {b}.doc_id and {a}.s - {b}.e <= {SCOPE} and {b}.s - {a}.e <= {SCOPE}"
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(parts)}),
base as (select * from spans where kind < 3),
apart as (select * from spans w where kind >= 3 and not exists (select 1 from base b where b.doc_id = w.doc_id and b.s <= w.s and w.e <= b.e)),
keys as (select w.* from apart w where kind = 3 and exists (select 1 from base a where a.kind = 1 and {near("w", "a")})),
secrets as (select * from base where kind = 0 union all select * from keys),
urls as (select w.* from apart w where kind = 4 and exists (select 1 from base a where a.kind = 1 and {near("w", "a")}) and exists (select 1 from secrets a where {near("w", "a")})),
everything as (select * from base union all select * from keys union all select * from urls),
b as (select doc_id, count(*) filter (where kind = 0) as n0, count(*) filter (where kind = 1) as n1, count(*) filter (where kind = 2) as n2, {text} as x from base group by doc_id),
a as (select doc_id, {text} as x from everything group by doc_id)
select t.doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(b.x, '')) as base_sha256, coalesce(a.x, '') as spans
from t left join b on t.doc_id = b.doc_id left join a on t.doc_id = a.doc_id
"""
