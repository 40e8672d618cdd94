"""Quotes found again in source texts."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storynet.functions import text as tx
from storynet.functions.shared import fold_sorted
from storynet.operators.mentions import found_in
from storynet.functions.shared import saved

_DROP = re.compile(r"[\s*_`~]")
GRAM = 12
#: Distinct quotes or texts of a batch that meet in one row of fuzzy_locate.
BLOCK = 64


def quote_contains(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """``quotes``(chat_id, ref, quote) whose normalised text lies in that of their source (chat_id, ref, content)."""
    rows = quotes.join(sources, ["chat_id", "ref"])
    q, s = tx.anchor_text(F.col("quote")), tx.anchor_text(F.col("content"))
    return rows.filter((q != "") & F.contains(s, q)).select(*quotes.columns)


def quote_search(quotes: DataFrame, sources: DataFrame, gram: int = GRAM) -> DataFrame:
    """``quotes``(quote_id, quote) in any of ``sources``(ref, content): quote_id, ref.

    Blocking: the normalised text is cut into pieces of ``gram`` characters. A quote of 2 * gram - 1 characters or more covers a
    whole piece wherever it stands, and that piece is one of the quote's first ``gram`` grams. Shorter quotes are blocked in the same
    way by pieces of half the length, and so on down to single characters; a level without quotes costs nothing. Only ids and pieces
    are shuffled to find who may match whom; texts are joined for those pairs alone.
    """
    q = saved(quotes.select("quote_id", tx.anchor_text(F.col("quote")).alias("q")).filter("q <> ''"))
    s = sources.select("ref", tx.anchor_text(F.coalesce("content", F.lit(""))).alias("s"))
    levels, most = [], None
    while gram >= 1:
        levels.append((gram, 2 * gram - 1, most))
        gram, most = gram // 2, 2 * gram - 1
    there = {r[0] for r in q.select(_level(F.length("q"), levels)).distinct().collect()}  # as many rows as levels
    asked, pieces = None, []
    for size, low, high in levels:
        if size not in there:
            continue
        own = q.filter(F.length("q") >= low)
        own = own.filter(F.length("q") < high) if high else own
        heads = F.array(*[F.substr(F.col("q"), F.lit(i + 1), F.lit(size)) for i in range(size)])
        rows = own.select("quote_id", F.explode(F.array_distinct(heads)).alias("g"))
        asked = rows if asked is None else asked.unionByName(rows)
        # one pass over the text: a substring by place would count its characters from the start again for every piece
        pieces.append(F.when(F.length("s") >= low, F.regexp_extract_all("s", F.lit(f"(?s).{{{size}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    if asked is None:
        return q.join(s, F.lit(False)).select("quote_id", "ref")
    # pieces of all levels from one reading: their lengths keep them apart
    keyed = s.select("ref", F.explode(F.array_distinct(F.concat(*pieces))).alias("g"))
    met = keyed.join(asked, "g").select("quote_id", "ref").distinct()
    return met.join(q, "quote_id").join(s, "ref").filter(F.contains("s", "q")).select("quote_id", "ref")


def _level(length: Column, levels: list[tuple[int, int, int | None]]) -> Column:
    """The piece size by which a quote of this length is blocked."""
    return F.coalesce(*[F.when(length >= low, size) for size, low, _ in levels])


def spans_of(quote: str, text: str) -> list[tuple[int, int]]:
    """All places of the normalised quote in the normalised text, overlapping ones too, in places of the raw text."""
    import unicodedata

    keep = [i for i, c in enumerate(text) if not (_DROP.match(c) or unicodedata.category(c)[0] in "PZ")]
    body = "".join(text[i] for i in keep)
    want = "".join(c for c in quote if not (_DROP.match(c) or unicodedata.category(c)[0] in "PZ"))
    out, at = [], body.find(want) if want else -1
    while at >= 0:
        out.append((keep[at], keep[at + len(want) - 1] + 1))
        at = body.find(want, at + 1)
    return out


def quote_spans(pairs: DataFrame) -> DataFrame:
    """``pairs``(quote_id, ref, quote, content) to quote_id, ref, start, end of every occurrence."""

    def scan(batches):
        for b in batches:
            rows = [(i, r, a, e) for i, r, q, t in zip(*(b.column(c).to_pylist() for c in ("quote_id", "ref", "quote", "content")), strict=True) for a, e in spans_of(q or "", t or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["quote_id", "ref", "start", "end"])

    return pairs.select("quote_id", "ref", "quote", "content").mapInArrow(scan, "quote_id long, ref string, start long, end long")


def locate_in_order(spans: DataFrame) -> DataFrame:
    """``spans``(batch, ord, pos): for each quote in order the first position after that of the one before; one that has none does not move on.

    One pass over a batch's sorted quotes; batch, ord, pos (null if not found).
    """
    rows = spans.groupBy("batch", "ord").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    kind = spans.schema["batch"].dataType.simpleString()

    def step(cursor: int, row: tuple) -> tuple:
        batch, ord_, places = row
        pos = next((x for x in places if x > cursor), None)
        return (cursor if pos is None else pos), (batch, ord_, pos)

    plain = rows.select("batch", F.col("ord").cast("long").alias("ord"), F.col("places").cast("array<bigint>").alias("places"))
    return fold_sorted(plain, "batch", "ord", lambda: -1, step, f"batch {kind}, ord long, pos long")


def recover_fragments(lost: DataFrame, sources: DataFrame, least: int = 10) -> DataFrame:
    """``lost``(batch, ord, quote, cursor): quotes that were not found, split at sentence marks; the longest fragment with one place after the cursor.

    ``sources``(batch, body): a batch's normalised text. Gives batch, ord, pos. The first quote of a batch is never recovered.
    """
    parts = F.explode(F.split("quote", r"[。！？!?.;；\n]+")).alias("part")
    rows = lost.filter("ord > 0").select("batch", "ord", "cursor", parts).withColumn("part", tx.anchor_text(F.col("part")))
    rows = rows.filter(F.length("part") >= least).join(sources, "batch")
    rest = F.substr(F.col("body"), (F.col("cursor") + 2).cast("int"))
    first = F.instr(rest, F.col("part"))
    again = F.instr(F.substr(rest, first + 1), F.col("part"))
    rows = rows.withColumn("first", first).filter((F.col("first") > 0) & (again == 0))
    rank = F.row_number().over(W.partitionBy("batch", "ord").orderBy(F.length("part").desc(), "first"))
    return rows.withColumn("rank", rank).filter("rank = 1").select("batch", "ord", (F.col("cursor") + F.col("first")).cast("long").alias("pos"))


def _places(quote: str) -> dict[str, int]:
    """A bit for each place of each character of the quote."""
    at: dict[str, int] = {}
    for i, c in enumerate(quote):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _subsequence(at: dict[str, int], n: int, text: str) -> int:
    """The length of the longest common subsequence of ``text`` and a quote of ``n`` characters with these places."""
    v = full = (1 << n) - 1
    for c in text:
        if m := v & at.get(c, 0):
            v = ((v + m) | (v - m)) & full
    return n - v.bit_count()


def most_similar(quotes: list[str], units: list[tuple[str, object]], least: float) -> list[tuple[str, object, float]]:
    """quote, unit and ratio of the most similar of ``units``(text, unit) that reaches ``least``; of equal ones the greatest unit.

    The sequence matcher runs only where neither the lengths nor the longest common subsequence rule a pair out: its matching blocks
    are a common subsequence, so both bounds are exact. The subsequence is counted with a bit for each character of the quote.
    """
    out = []
    for quote in quotes:
        at, n, best = _places(quote), len(quote), None
        for bound, text, unit in sorted(((2.0 * min(n, len(t)) / (n + len(t)), t, u) for t, u in units), key=lambda x: -x[0]):
            need = best[0] if best else least
            if bound < need:
                break
            if 2.0 * _subsequence(at, n, text) / (n + len(text)) < need:
                continue
            ratio = SequenceMatcher(None, quote, text, autojunk=False).ratio()
            if ratio >= least and (best is None or (ratio, unit) > best):
                best = ratio, unit
        if best:
            out.append((quote, best[1], best[0]))
    return out


def fuzzy_locate(quotes: DataFrame, units: DataFrame, least: float = 0.62, shortest: int = 6) -> DataFrame:
    """``quotes``(batch, quote_id, quote), ``units``(batch, unit, text): the most similar unit, with at least ``least``.

    Distinct quotes and texts of a batch meet in blocks of about ``BLOCK``, dealt out by batch and both block numbers, so that no batch
    is one task. Texts whose length suits no quote of their batch leave first; the work that is left grows with quotes times texts of a batch.
    """
    asked = quotes.filter(F.length("quote") >= shortest)
    q = asked.select("batch", "quote").distinct()
    span = q.groupBy("batch").agg(F.ceil(F.count("*") / BLOCK).alias("nq"), F.min(F.length("quote")).alias("low"), F.max(F.length("quote")).alias("high"))
    n, near = F.length("text"), F.least(F.greatest(F.length("text"), "low"), "high")
    u = units.groupBy("batch", "text").agg(F.max("unit").alias("unit")).join(span, "batch").filter(2 * F.least(n, near) / (n + near) >= least)
    sizes = u.groupBy("batch", "nq").agg(F.ceil(F.count("*") / BLOCK).alias("nu"))
    q = q.join(sizes, "batch").withColumn("qs", F.pmod(F.xxhash64("quote"), "nq")).groupBy("batch", "qs", "nu").agg(F.collect_list("quote").alias("quotes"))
    u = u.select("batch", "text", "unit").join(sizes, "batch").withColumn("us", F.pmod(F.xxhash64("text"), "nu")).groupBy("batch", "us", "nq").agg(F.collect_list(F.struct("text", "unit")).alias("units"))
    q = q.select("batch", "qs", "quotes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nu") - 1)).alias("us"))
    u = u.select("batch", "us", "units", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qs"))

    def score(batches):
        for b in batches:
            kinds = b.schema.field("batch").type, pa.string(), b.schema.field("units").type.value_type.field("unit").type, pa.float64()
            rows = [(k, *m) for k, qs, us in zip(*(b.column(c).to_pylist() for c in ("batch", "quotes", "units")), strict=True) for m in most_similar(qs, [(x["text"], x["unit"]) for x in us], least)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["batch", "quote", "unit", "ratio"])

    kinds = f"batch {quotes.schema['batch'].dataType.simpleString()}, quote string, unit {units.schema['unit'].dataType.simpleString()}, ratio double"
    met = q.join(u, ["batch", "qs", "us"]).select("batch", "quotes", "units").mapInArrow(score, kinds)
    best = met.groupBy("batch", "quote").agg(F.max(F.struct("ratio", "unit")).alias("m"))
    rows = asked.join(best, ["batch", "quote"]).groupBy("batch", "quote_id").agg(F.max("m").alias("m"))
    return rows.select("batch", "quote_id", F.col("m.unit").alias("unit"), F.round("m.ratio", 6).alias("ratio"))


def nearest_part(quote: str, text: str, least: float) -> str | None:
    """The window of ``text`` most like ``quote``, its length within 2; none under ``least`` or if equally good ones lie over 2 apart.

    The sequence matcher's blocks are a common subsequence of quote and window, so one of quote and text, which rules most texts out. They cannot
    have more characters than quote and window share either, which is counted as the window moves; only windows that may reach the best so far are
    compared.
    """
    n = len(quote)
    if 2 * _subsequence(_places(quote), n, text) / (n + min(max(n - 2, 1), len(text))) < least:
        return None
    want, top, best = Counter(quote), [], least
    for size in range(max(n - 2, 1), n + 3):
        size = min(size, len(text))
        have, common = Counter(), 0
        for i, c in enumerate(text):
            have[c] += 1
            common += have[c] <= want[c]
            if i >= size:
                old = text[i - size]
                common -= have[old] <= want[old]
                have[old] -= 1
            if i >= size - 1 and 2 * common / (n + size) >= best:
                part = text[i - size + 1 : i + 1]
                ratio = SequenceMatcher(None, quote, part, autojunk=False).ratio()
                if ratio >= best:
                    top = [*(top if ratio == best else []), (i - size + 1, part)]
                    best = ratio
    return min(top)[1] if top and max(top)[0] - min(top)[0] <= 2 else None


def nearest_quote(quotes: DataFrame, sources: DataFrame, least: float = 0.88, shortest: int = 8) -> DataFrame:
    """``quotes``(quote_id, ref, quote) to the window of their source (ref, content) most like it: quote_id, part; as ``nearest_part``."""
    rows = quotes.filter(F.length("quote") >= shortest).join(sources.filter(F.length("content") > 0), "ref").select("quote_id", "quote", "content")

    def scan(batches):
        for b in batches:
            found = [nearest_part(q, t, least) for q, t in zip(b.column("quote").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("quote_id"), pa.array(found, pa.string())], ["quote_id", "part"])

    return rows.mapInArrow(scan, f"quote_id {quotes.schema['quote_id'].dataType.simpleString()}, part string").filter("part is not null")


def relocate_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """``evidence``(chat_id, evidence_id, ref, quote): adds found_ref, its own ref if the whole quote is there, else the only other one that has it, else null."""
    own = evidence.withColumn("q", tx.evidence_text(F.col("quote"))).filter("q <> ''")
    texts = sources.select("chat_id", "ref", tx.evidence_text(F.col("content")).alias("text"))
    found = found_in(own.select("chat_id", F.col("q").alias("needle")), texts)
    hits = own.join(found.select("chat_id", F.col("needle").alias("q"), F.col("ref").alias("at")), ["chat_id", "q"])
    found = hits.groupBy("chat_id", "evidence_id").agg(
        F.max(F.when(F.col("at") == F.col("ref"), F.col("at"))).alias("same"), F.count("*").alias("n"), F.min("at").alias("only")
    )
    rows = evidence.join(found, ["chat_id", "evidence_id"], "left")
    return rows.select(*evidence.columns, F.coalesce("same", F.when(F.col("n") == 1, F.col("only"))).alias("found_ref"))
