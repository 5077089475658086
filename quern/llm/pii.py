r"""Personal data and what gives it away, in DataFrame operations only.

Base entities (e-mail, IP, card, phone) are found by pattern. What is left
around an entity can still disclose it: a word that occurs with it and hardly
anywhere else. Following information-theoretic sanitisation, the corpus says how
much: a term's pointwise mutual information with the entity, as a share of the
entity's own information content. Terms above one share are removed, above a
lower one generalised.

Co-occurrence is counted in a window of characters on both sides of the entity,
cut at the nearest match of the same kind, so the pairs per entity are bounded.
Document frequencies are counted over all documents.

The patterns are those of the contract, written so that matching is linear in
the text: possessive runs, and no start inside a run that has just failed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.llm.columns import let, long_id

#: Kinds in the order in which spans are listed; the last two are terms.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "hint", "term")

_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TERM = r"\p{L}{3,}"

SPAN = "array<struct<start:long,end:long,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.char_length(digits)

    def step(total: Column, k: Column) -> Column:
        d = F.substring(digits, (n - k).cast("int"), F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return n.between(13, 19) & F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0).otherwise(False)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.rlike(v, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    "card": _luhn,
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


def located(text: Column, pattern: str, window: int = 0, block: int = 256) -> Column:
    """All matches with their places in code points, and ``window`` characters of the text between matches on both sides.

    Places are running sums over blocks of matches, then inside each block, as an
    array that grows by one is copied each time.
    """
    at, spans, starts = (F.lit(0).cast("long"), F.array().cast(SPAN), F.array().cast("array<long>"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["value"])
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            m["value"].alias("value"),
            (F.right(m["gap"], F.lit(window)) if window else F.lit(None).cast("string")).alias("left"),
            (F.left(m["after"], F.lit(window)) if window else F.lit(None).cast("string")).alias("right"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(matches: Column, first: Column) -> Column:
        return F.aggregate(matches, F.struct(first.alias("at"), spans.alias("out")), step)["out"]

    def note(acc: Column, own: Column) -> Column:
        after = F.aggregate(own, acc["at"], lambda n, m: n + F.char_length(m["gap"]) + F.char_length(m["value"]))
        return F.struct(after.alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def in_blocks(blocks: Column) -> Column:
        first = F.aggregate(blocks, F.struct(at.alias("at"), starts.alias("starts")), note)["starts"]
        return F.flatten(F.zip_with(blocks, first, placed))

    def cut(matches: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / block).cast("int")), lambda k: F.slice(matches, k * block + 1, block))

    def zipped(m: Column) -> Column:
        piece = lambda i: F.element_at(m["gaps"], i.cast("int"))
        return F.transform(m["found"], lambda v, i: F.struct(v.alias("value"), piece(i + 1).alias("gap"), piece(i + 2).alias("after")))

    def every(matches: Column) -> Column:
        return F.when(F.size(matches) > block, let(cut(matches), in_blocks)).otherwise(placed(matches, at))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    matches = let(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")), zipped)
    some = let(matches, every)
    return F.when(F.regexp_like(text, F.lit(pattern)), some).otherwise(spans)


def base_spans(text: Column, kind: str, window: int = 0) -> Column:
    """The valid spans of a base kind."""
    return F.filter(located(text, PATTERNS[kind], window), lambda s: VALID[kind](s["value"]))


def span_list(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _window_terms(window: int) -> Column:
    """The terms of an exploded span's window, with places; a word at the window's cut edge is left out."""
    left = F.when(F.char_length("s.left") >= window, F.regexp_replace("s.left", r"^\p{L}+", "")).otherwise(F.col("s.left"))
    right = F.when(F.char_length("s.right") >= window, F.regexp_replace("s.right", r"\p{L}+$", "")).otherwise(F.col("s.right"))
    before, after = F.col("s.start") - F.char_length(left), F.col("s.end")
    move = lambda spans, by: F.transform(spans, lambda t: F.struct((t["start"] + by).alias("start"), (t["end"] + by).alias("end"), F.xxhash64(F.lower(t["value"])).alias("term")))
    return F.concat(move(located(left, TERM), before), move(located(right, TERM), after))


def _tagged(kind: str) -> Column:
    """The spans of a kind with the entity, which is the kind with the value."""
    return F.transform(kind, lambda s: F.struct(F.xxhash64(F.lit(kind), F.lower(s["value"])).alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["left"].alias("left"), s["right"].alias("right")))


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 60,
    support: int = 3,
    generalise_at: float = 0.75,
    remove_at: float = 0.9,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: ``row, doc_id``, an array of spans for each base kind, and ``hint`` and ``term`` spans.

    With ``with_text`` the text follows, null as empty.

    A term discloses an entity if it occurs in the entity's window in at least
    ``support`` documents with at least two different windows, and its mutual
    information reaches the given share of the entity's information. Only
    occurrences in windows of that entity are spans.

    * Null text is empty. Places are code points, end exclusive.
    * Repeated rows and ids are documents of their own; copies add to counts but
      not to the different windows. Empty tables give empty results.
    * Every word's documents are counted, whether or not it is near an entity;
      counts are combined before the shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), long_id(docs, id_col).alias("doc_id"), text.alias("text"))
    kept = ["text"] if with_text else []
    base = scratch.table(rows.select("row", "doc_id", *[base_spans(F.col("text"), k, window).alias(k) for k in BASE], *kept), "spans", codec="zstd")

    tagged = [_tagged(k) for k in BASE]
    near = base.filter(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in BASE])).select("row", F.explode(F.concat(*tagged)).alias("s"))
    near = near.select("row", F.col("s.entity").alias("entity"), F.xxhash64("s.left", "s.right").alias("place"), F.explode(_window_terms(window)).alias("t")).select("row", "entity", "place", "t.*")
    near = scratch.table(near, "near")

    pairs = near.groupBy("entity", "term", "row").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter((F.col("both") >= support) & (F.col("lo") < F.col("hi")))
    pairs = scratch.table(pairs.select("entity", "term", "both"), "pairs")
    entities = near.join(pairs.select("entity").distinct(), "entity", "left_semi").select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"))

    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(w)))
    frequency = rows.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    n = base.count()

    content = math.log2(max(n, 1)) - F.log2(F.col("with_entity").cast("double"))
    told = F.log2(F.col("both") * F.lit(float(n)) / (F.col("with_entity") * F.col("with_term")))
    share = F.when(content > 0, told / content).otherwise(0.0)
    judged = pairs.join(entities, "entity").join(frequency, "term").select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise_at)
    judged = scratch.table(judged, "judged")
    flagged = near.join(judged, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    place = F.array_sort(F.collect_list(F.struct("start", "end", "share")))
    flagged = flagged.groupBy("row").agg(place.alias("told"))
    of = lambda test: F.coalesce(F.transform(F.filter("told", test), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))), F.array().cast("array<struct<start:long,end:long>>"))
    return base.join(flagged, "row", "left").select(
        "row", "doc_id", *BASE, of(lambda t: t["share"] < remove_at).alias("hint"), of(lambda t: t["share"] >= remove_at).alias("term"), *kept
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """What :func:`find` returns, with the text in which its spans are replaced or removed as ``redacted``."""
    found = find(docs, id_col, text_col, with_text=True, **settings)
    return found.withColumn("redacted", redact(F.col("text"), {k: F.col(k) for k in KINDS})).drop("text")


def listed(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of each base kind, the digest of the base spans, and all spans as text.

    After :func:`sanitise` also the length and the digest of the redacted text.
    """
    lists = {k: span_list(F.col(k), k) for k in KINDS}
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.concat(*[lists[k] for k in BASE]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*lists.values()), ",").alias("spans"),
        F.size("hint").cast("long").alias("n_hint"),
        F.size("term").cast("long").alias("n_term"),
        *([F.char_length("redacted").cast("long").alias("redacted_chars"), F.sha2("redacted", 256).alias("redacted_sha256")] if "redacted" in found.columns else []),
    )


def _replaced(spans: Column, kind: str) -> Column:
    """Spans as start, negative end, and what stands in their place."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit("" if kind == "term" else f"[{kind.upper()}]").alias("as")))


def redact(text: Column, found: dict[str, Column]) -> Column:
    """The text with base spans and hints replaced by their kind in brackets, and terms removed.

    Spans that overlap are replaced as one, by what the earliest stands for, the
    longest if some start together.
    """
    spans = F.array_sort(F.concat(*[_replaced(s, k) for k, s in found.items()]))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(clear, s["as"])).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(spans, start, step)
    rest = F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
