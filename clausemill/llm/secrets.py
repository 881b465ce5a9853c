"""Secret scans: multipart credential linking with DataFrame functions only.

Strong candidates (assignments to secret names, AKIA access identifiers, long hex runs) are always reported.
Weak ones (other identifiers, weaker secret names, endpoints) are reported only where complementary parts meet:
the parts of a text are intervals, joined where the gap between them is below `scope` code points. A weak
secret needs an identifier, an identifier needs a secret, an endpoint needs both.

The interval join is a sweep over the parts in order of their starts, once from the left with the furthest end of each
role so far, once from the right with the nearest start: that decides whether any complement is near, without pairs.

All of it happens within the row: nothing is shuffled, so a hot source or copied text costs no more than
others. Positions and sweeps run in two levels of blocks, so that a text with very many matches stays near linear.

Defined cases: a null text is empty and has no spans; repeated rows are repeated; other columns stay as they
are in `redact` and aren't read by `scan`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    least: int  # code points of the group
    gate: str = ""  # literal that any match contains


VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = Kind("assign", r"((?i:password|passwd|secret|token|api_?key))" + VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 6)
ACCESS = Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA")
HEX = Kind("hex", r"[0-9a-f]{24,}", 0, 24)
IDENT = Kind("ident", r"((?i:client_?id|access_?key_?id|account|user_?name|user|login))" + VALUE + r"([A-Za-z0-9_.@-]+)", 2, 3)
WEAK = Kind("weak", r"((?i:pwd|pass|private_?key|access_?key|auth|credential))" + VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 6)
ENDPOINT = Kind("endpoint", r"https?://[A-Za-z0-9.:/_?&=%-]+", 0, 10, "http")
#: The order in which spans with one start are listed.
KINDS = (ASSIGN, ACCESS, HEX, IDENT, WEAK, ENDPOINT)

SPANS = "array<struct<start:int,kind:int,end:int>>"  # in the order in which spans are sorted
EMPTY = f"cast(array() as {SPANS})"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans_sql(kind: Kind, text: str) -> str:
    """SQL: the spans (start, end, kind) of a kind's matches in a text column, in code points, end exclusive.

    Matches are leftmost and don't overlap; those whose group is too short are dropped afterwards. Empty for
    texts without a match, found by one scan.
    """
    p = _quoted(kind.pattern)
    here = (f"contains({text}, '{kind.gate}') and " if kind.gate else "") + f"rlike({text}, {p})"
    parts = f"arrays_zip(transform(split({text}, {p}, -1), g -> length(g)), transform(regexp_extract_all({text}, {p}, 0), h -> length(h)), transform(regexp_extract_all({text}, {p}, {kind.group}), h -> length(h)))"
    parts = f"transform({parts}, x -> struct(x['0'] as g, coalesce(x['1'], 0) as h, coalesce(x['2'], -1) as n))"
    blocks = f"transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> slice(z, cast(b * {BLOCK} + 1 as int), {BLOCK}))"
    placed = (
        "aggregate(b, struct(o as at, {e} as out), (acc, v) -> struct(acc.at + v.g + v.h as at, "
        "if(v.n >= {n}, concat(acc.out, array(struct(acc.at + v.g as start, {k} as kind, acc.at + v.g + v.h as end))), acc.out) as out), acc -> acc.out)"
    ).format(e=EMPTY, n=kind.least, k=KINDS.index(kind))
    offsets = "aggregate(transform(bs, b -> aggregate(b, 0, (s, v) -> s + v.g + v.h)), struct(0 as at, cast(array() as array<int>) as out), (acc, t) -> struct(acc.at + t as at, concat(acc.out, array(acc.at)) as out), acc -> acc.out)"
    # a one-element transform names an intermediate value
    summed = f"transform(array({offsets}), os -> flatten(zip_with(bs, os, (b, o) -> {placed})))[0]"
    return f"if({here}, transform(array({parts}), z -> transform(array({blocks}), bs -> {summed})[0])[0], {EMPTY})"


IDS, SECRETS = "(1, 3)", "(0, 2, 4)"  # kinds that identify, kinds that are secret


def _swept(spans: str, best: str, edge: str) -> str:
    """SQL: for each of the spans, in their order, (i, s): the best edge of the identifiers and of the secrets before it."""
    one = "array<struct<i:int,s:int>>"
    blocks = f"transform(sequence(0, (size({spans}) - 1) div {BLOCK}), k -> slice({spans}, cast(k * {BLOCK} + 1 as int), {BLOCK}))"
    pick = {"greatest": "array_max", "least": "array_min"}[best]
    sums = f"transform(bs, b -> struct({pick}(transform(filter(b, x -> x.kind in {IDS}), x -> x.{edge})) as i, {pick}(transform(filter(b, x -> x.kind in {SECRETS}), x -> x.{edge})) as s))"
    before = f"aggregate({sums}, struct(cast(null as int) as i, cast(null as int) as s, cast(array() as {one}) as out), (acc, v) -> struct({best}(acc.i, v.i) as i, {best}(acc.s, v.s) as s, concat(acc.out, array(struct(acc.i as i, acc.s as s))) as out), acc -> acc.out)"
    inner = f"aggregate(b, struct(p.i as i, p.s as s, cast(array() as {one}) as out), (acc, v) -> struct(if(v.kind in {IDS}, {best}(acc.i, v.{edge}), acc.i) as i, if(v.kind in {SECRETS}, {best}(acc.s, v.{edge}), acc.s) as s, concat(acc.out, array(struct(acc.i as i, acc.s as s))) as out), acc -> acc.out)"
    return f"transform(array({blocks}), bs -> flatten(zip_with(bs, {before}, (b, p) -> {inner})))[0]"


def linked_sql(parts: str, scope: int) -> str:
    """SQL: of the parts, sorted, the weak ones whose complements are near."""
    near = lambda role: f"coalesce(x.l.{role} > x.p.start - {scope}, false) or coalesce(x.r.{role} < x.p.end + {scope}, false)"
    rows = f"zip_with(zip_with({parts}, {_swept(parts, 'greatest', 'end')}, (p, l) -> struct(p, l)), reverse({_swept(f'reverse({parts})', 'least', 'start')}), (a, r) -> struct(a.p as p, a.l as l, r as r))"
    return f"transform(filter({rows}, x -> (x.p.kind in (3, 5) and ({near('s')}) or x.p.kind = 4) and (x.p.kind in (4, 5) and ({near('i')}) or x.p.kind = 3)), x -> x.p)"


def findings(text: Column, docs: DataFrame, scope: int = 200) -> DataFrame:
    """docs plus the column _spans: all reported spans of the text, by start, then kind."""
    found = docs.withColumn("_t", F.coalesce(text.cast("string"), F.lit("")))
    found = found.withColumns({f"_{k.name}": F.expr(spans_sql(k, "_t")) for k in (ASSIGN, ACCESS, HEX, IDENT)})
    found = found.withColumn("_ids", F.concat("_access", "_ident"))
    # weak secrets can only count beside an identifier, endpoints only beside identifiers and secrets
    found = found.withColumn("_weak", F.expr(f"if(size(_ids) = 0, {EMPTY}, {spans_sql(WEAK, '_t')})"))
    found = found.withColumn("_secrets", F.concat("_assign", "_hex", "_weak"))
    found = found.withColumn("_endpoint", F.expr(f"if(size(_ids) = 0 or size(_secrets) = 0, {EMPTY}, {spans_sql(ENDPOINT, '_t')})"))
    parts = "array_sort(concat(_ids, _secrets, _endpoint))"
    linked = F.expr(f"if(size(_ids) = 0 or size(_secrets) = 0, {EMPTY}, transform(array({parts}), ps -> {linked_sql('ps', scope)})[0])")
    found = found.withColumns({"_base": F.expr("array_sort(concat(_assign, _access, _hex))"), "_linked": linked})
    return found.withColumn("_spans", F.expr("array_sort(concat(_base, _linked))"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans) per row; base and spans are arrays of (start, kind, end)."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = findings(F.col("text"), plain, scope)
    sizes = [F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in (ASSIGN, ACCESS, HEX)]
    return found.select("id", *sizes, F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = 200, text_col: str = "text") -> DataFrame:
    """docs with every reported span of the text replaced by the mark; all other columns as they are."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_text"))
    found = findings(F.col("_text"), inner, scope)
    rest = "substring(_t, acc.at + 1, greatest(s.start - acc.at, 0))"
    text = f"""aggregate(_spans, struct(0 as at, cast(array() as array<string>) as out), (acc, s) -> if(s.start < acc.at,
        struct(greatest(acc.at, s.end) as at, acc.out as out),
        struct(s.end as at, concat(acc.out, array({rest}, '{mark}')) as out)), acc -> concat(array_join(acc.out, ''), substring(_t, acc.at + 1)))"""
    text = F.expr(f"if(size(_spans) = 0, _text, {text})")
    return found.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
