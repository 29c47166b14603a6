"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns are reported as they are.  Three kinds of weak part mean little alone: long opaque
strings (perhaps secrets), account names (identifiers) and service addresses (endpoints).
A weak part is reported only where complementary parts lie in its scope, beside it with at most SCOPE characters between them in the same text:

* a weak secret next to an identifier (access key or account name),
* an account name next to a secret (base or weak),
* an endpoint next to both.

"Next to" is an interval join on cells of SCOPE characters for starts and for ends: a cell keeps the first and the last
place of a kind, so the join has at most four rows for each part and what it needs, and never the pairs of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import row_column, stored, text_of

#: kind -> (pattern, shortest length of the last group or match); the first three are the base.
KINDS = {
    "assign": ("""(?i)(?:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": ("AKIA[A-Z0-9]{16,}", 20),
    "hex": ("[0-9a-f]{24,}", 24),
    "weak_secret": ("[A-Za-z0-9+/_-]{32,}", 32),
    "weak_id": ("""(?i)(?:user(?:name)?|login|account|client_?id)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9@._-]+)""", 3),
    "endpoint": ("(?:https?|ftps?|amqps?|redis|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z]+)://[^\\x20\\x09-\\x0D\"'<>]+", 12),
}
BASE = ["assign", "access", "hex"]
#: Which parts a kind stands for, and which it needs in scope (of each inner tuple one).
PARTS = {"secret": ("assign", "hex", "weak_secret"), "identifier": ("access", "weak_id")}
NEEDS = {"weak_secret": ("identifier",), "weak_id": ("secret",), "endpoint": ("secret", "identifier")}
SCOPE = 400


def _lengths(kind: str, text: Column) -> Column:
    """Lengths of the gaps before the matches, of the matches, and of what must be long enough.

    A regular expression splits a text into exactly the gaps between its leftmost non-overlapping matches.
    """
    pattern, _ = KINDS[kind]
    grouped = 1 if "(" in pattern.replace("(?", "") else 0
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    last = F.regexp_extract_all(text, F.lit(pattern), F.lit(grouped))
    return F.struct(F.lit(kind).alias("kind"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("match"), F.transform(last, F.length).alias("last"))


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, kind, start, end`` of all candidate parts of ``doc_id, text``; *mark* is the text's hash."""
    text = F.col("text")
    lists = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.array_compact(F.array(*[F.when(text.rlike(p), _lengths(k, text)) for k, (p, _) in KINDS.items()])).alias("found"))
    rows = lists.filter("size(found) > 0").select("doc_id", "mark", F.inline("found")).distinct()
    pairs = F.arrays_zip(F.slice("gap", 1, F.size("match")).alias("gap"), F.col("match"), F.col("last"))
    each = rows.select("doc_id", "mark", "kind", F.posexplode(pairs).alias("nth", "at"))
    each = each.select("doc_id", "mark", "kind", "nth", F.col("at.gap").alias("gap"), F.col("at.match").alias("match"), F.col("at.last").alias("last"))
    order = Window.partitionBy("doc_id", "mark", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("match")).over(order)
    least = F.create_map(*[F.lit(x) for k, (_, n) in KINDS.items() for x in (k, n)])[F.col("kind")]
    return each.withColumn("end", end).filter(F.col("last") >= least).select("doc_id", "mark", "kind", (F.col("end") - F.col("match")).alias("start"), "end")


def linked(parts: DataFrame) -> DataFrame:
    """The base spans and those weak ones whose complementary parts lie in scope.

    A partner begins in the SCOPE characters from a part's end on, or ends in those before its start: what overlaps the part
    does neither, so a stretch never supports itself.  Both are questions for two cells, and the first and
    last place in a cell answer them exactly.
    """
    def cell(at: Column | str) -> Column:
        return F.floor((F.col(at) if isinstance(at, str) else at) / SCOPE)

    named = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), F.lit(part)) for part, kinds in PARTS.items()]))
    edges = F.array(F.struct(F.lit("after").alias("side"), F.col("start").alias("at")), F.struct(F.lit("before").alias("side"), F.col("end").alias("at")))
    edge = parts.withColumn("part", F.explode(named)).withColumn("edge", F.explode(edges)).select("doc_id", "mark", "part", "edge.side", cell("edge.at").alias("cell"), "edge.at")
    cells = edge.groupBy("doc_id", "mark", "part", "side", "cell").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    weak = parts.filter(~F.col("kind").isin(*BASE))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("kind")]
    # in the part's own cell a place beyond its edge is near enough, in the cell beside it a near place is beyond the edge
    asks = F.array(*[F.struct(F.lit(side).alias("side"), (cell(at) + d).alias("cell"), low.alias("low"), high.alias("high")) for side, at, d, low, high in (
        ("after", "end", 0, F.col("end"), F.lit(None).cast("bigint")), ("after", "end", 1, F.lit(None).cast("bigint"), F.col("end") + SCOPE),
        ("before", "start", 0, F.lit(None).cast("bigint"), F.col("start")), ("before", "start", -1, F.col("start") - SCOPE, F.lit(None).cast("bigint")))])
    asked = weak.withColumn("part", F.explode(needs)).withColumn("ask", F.explode(asks)).select("*", "ask.side", "ask.cell", "ask.low", "ask.high")
    same = [F.col(f"w.{c}") == F.col(f"c.{c}") for c in ("mark", "part", "side", "cell")]
    met = asked.alias("w").join(cells.alias("c"), F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & same[0] & same[1] & same[2] & same[3])
    met = met.filter((F.col("low").isNull() | (F.col("hi") >= F.col("low"))) & (F.col("high").isNull() | (F.col("lo") <= F.col("high"))))
    met = met.select("w.doc_id", "w.mark", "w.kind", "w.start", "w.end", "w.part").distinct()
    met = met.groupBy("doc_id", "mark", "kind", "start", "end").count().filter(F.col("count") == F.size(needs)).drop("count")
    return parts.filter(F.col("kind").isin(*BASE)).unionByName(met)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of *docs* with ``spans``: an array of (start, place of the kind, end, kind), sorted.

    Places count code points; the end is exclusive.  A null text is an empty one and has no span; a
    null id is an id like others; rows with equal id and text have equal spans; an empty
    table gives an empty table.  The new column gets a leading underscore where *docs* has such a name.
    """
    new = row_column(docs, "spans")
    keyed = docs.withColumn("__id", F.col(id_col).cast("string")).withColumn("__mark", F.xxhash64(text_of(text_col)))
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    place = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int")
    found = linked(stored(spans(texts))).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("__spans"))  # bounded by the text
    found = found.withColumnsRenamed({"doc_id": "__doc", "mark": "__sum"})
    out = keyed.join(found, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__mark") == F.col("__sum")), "left")
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return out.select(*[keyed[c] for c in docs.columns], F.coalesce("__spans", none).alias(new))


def redact(scanned: DataFrame, *, text_col: str = "text", spans_col: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """*scanned* with every stretch covered by its spans replaced by *mask*; the spans column goes."""
    text = text_of(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate(F.col(spans_col), start, step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(F.col(text_col))).drop(spans_col)
