"""Number claims in texts: finding them, binding them to metrics, checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How a figure is written, and which words around it make it no claim.
NUMBER = r"[$€£]?\s*(?:-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)\s*[KkMmBb]?\s*%?"
NUMBER_PARTS = r"([$€£])?\s*(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)\s*([KkMmBb])?\s*(%)?"
BEFORE_STRUCTURE = (
    r"(?i)(?<![a-z])(?:top|bottom|next|last|first|past|previous|prior|upcoming|section|step|phase|part|chapter|tier|figure|fig|table|page|no|number|"
    r"rank|priority|priorities|item|decision|action|recommendation|option|scenario|q[1-4]?)\s*[:#.\-]?\s*$"
)
AFTER_TIME_UNIT = r"(?i)^\s*[-_/]?\s*(?:d|w|m|q|y|h|days?|weeks?|months?|quarters?|years?|hours?|mins?|minutes?|business\s+days?)(?![a-z])"
AFTER_ENUMERATION = (
    r"(?i)^\s*(?:key\s+|main\s+|core\s+|top\s+|major\s+)?(?:priorit(?:y|ies)|recommendations?|actions?|risks?|opportunit(?:y|ies)|insights?|points?|"
    r"reasons?|factors?|steps?|areas?|ways?|tips?|strateg(?:y|ies)|initiatives?|options?|sections?|takeaways?|highlights?|findings?|bullets?|themes?|"
    r"phases?|stages?)(?![a-z])"
)
AFTER_ORDINAL = r"^[.)]\s"
CHANGE_VERB = (
    r"(?i)((?:(?:fell|dropped|declined|decreased|shrank|contracted|slipped|lost|rose|grew|increased|gained|climbed|improved|expanded)\s+(?:by\s+)?|"
    r"(?:a\s+|an\s+)?(?:decline|drop|decrease|fall|reduction|loss|increase|gain|rise|growth)\s+of\s+))\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"
)
WORTH_LINE = r"(?im)^[ \t]*[-*+][ \t]*\*\*\s*what\s+it'?s?\s+worth\s*:?\s*\*\*(.*)$"
TOKEN = r"\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"
# Figures that say what an action is worth.
WORTH_KEYS = ["discount_given", "margin_drag_revenue", "top_product_revenue", "gross_profit", "repeat_revenue", "one_time_revenue"]

_MARK = "\u0001"
_REACH = 48


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut so that every second piece is a match of the pattern."""
    clean = F.translate(text, _MARK, " ")
    return F.split(F.regexp_replace(clean, "(" + pattern + ")", _MARK + "$1" + _MARK), _MARK)


def material_numbers(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Every number that claims something: (doc, pos, raw, value, kind, near).

    The whole text is cut at its numbers once; the words around a number are read
    from the neighbouring pieces, so a long text costs its length, not its square.
    """
    cut = docs.select(F.col(doc).alias("doc"), _pieces(F.col(text), NUMBER).alias("s"))
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: (i % 2 == 1) & (i < F.size("s")))
    lead = r"^([$€£]?\s*)"
    around = F.transform(spots, lambda i: F.struct(
        i.alias("pos"), F.get("s", i).alias("raw"),
        F.right(F.concat(F.array_join(F.slice("s", F.greatest(F.lit(1), i - _REACH + 1), F.least(i, F.lit(_REACH))), ""), F.regexp_extract(F.get("s", i), lead, 1)), F.lit(_REACH)).alias("back"),
        F.left(F.array_join(F.slice("s", i + 2, F.lit(_REACH)), ""), F.lit(24)).alias("after")))
    rows = cut.select("doc", F.inline(around))
    parts = [F.regexp_extract("raw", NUMBER_PARTS, g) for g in (1, 2, 3, 4)]
    scale = F.when(F.lower(parts[2]) == "k", 1e3).when(F.lower(parts[2]) == "m", 1e6).when(F.lower(parts[2]) == "b", 1e9).otherwise(1.0)
    kind = F.when(parts[0] != "", "currency").when(parts[3] != "", "percent").otherwise("number")
    line = F.regexp_extract("back", r"([^\n]*)\z", 1)
    read = rows.select("doc", "pos", F.trim("raw").alias("raw"), (F.translate(parts[1], ",", "").try_cast("double") * scale).alias("value"), kind.alias("kind"),
                       line.alias("near"), "after").where("value is not null")
    whole = F.col("value") == F.floor("value")
    structure = (F.col("kind") == "number") & (
        (whole & F.col("value").between(1900, 2100)) | F.rlike(F.right("near", F.lit(24)), F.lit(BEFORE_STRUCTURE)) | F.rlike("after", F.lit(AFTER_TIME_UNIT))
        | F.rlike("after", F.lit(AFTER_ENUMERATION)) | (whole & F.col("value").between(0, 99) & (F.trim("near") == "") & F.rlike("after", F.lit(AFTER_ORDINAL))))
    return read.where(~structure).drop("after")


def extract_claims(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Distinct claims per text, with how often and where they come first."""
    return distinct_claims(material_numbers(docs, doc, text))


def distinct_claims(numbers: DataFrame) -> DataFrame:
    return numbers.groupBy("doc", "kind", F.round("value", 4).alias("value")).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"), F.min_by("raw", "pos").alias("raw"))


# --- matching -----------------------------------------------------------------


def significant(v: Column, digits: int) -> Column:
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, 0.0).otherwise(F.bround(v * power, 0) / power)


def agrees(claim: Column, known: Column) -> Column:
    """Within two percent or one half, or a rounding to two or three digits."""
    near = F.abs(claim - known) <= F.greatest(F.lit(0.5), 0.02 * F.greatest(F.abs(claim), F.abs(known)))
    return near | (F.abs(claim - significant(known, 2)) <= 1e-9) | (F.abs(claim - significant(known, 3)) <= 1e-9)


def _cell(v: Column) -> Column:
    """Which half-unit cell and which two-percent band a value lies in."""
    band = F.floor(F.log(F.abs(v)) / 0.0205)
    return F.array(F.concat(F.lit("L"), F.floor(v * 2).cast("string")),
                   F.concat(F.lit("G"), F.signum(v).cast("int").cast("string"), F.lit(":"), F.coalesce(band.cast("string"), F.lit("0"))))


def _cells_around(v: Column) -> Column:
    """The cells a value that agrees with *v* can lie in."""
    linear = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat(F.lit("L"), (F.floor(v * 2) + d).cast("string")))
    band = F.floor(F.log(F.abs(v)) / 0.0205)
    bands = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat(
        F.lit("G"), F.signum(v).cast("int").cast("string"), F.lit(":"), F.coalesce((band + d).cast("string"), F.lit("0"))))
    rounded = F.array(*[F.element_at(_cell(significant(v, d)), 1) for d in (2, 3)])
    return F.array_distinct(F.concat(linear, bands, rounded))


def match_figures(claims: DataFrame, known: DataFrame) -> DataFrame:
    """The first figure (by position) every claim agrees with, or none.

    A tolerance match is an equi-join on the cells a value can lie in, then the
    exact test; equal claims of all texts are looked up once.
    """
    wanted = claims.select("kind", "value").distinct()
    fractions = known.select("position", "figure", (F.col("figure") * 100).alias("v"), F.lit("percent").alias("only"))
    figures = known.select("position", "figure", F.col("figure").alias("v"), F.lit(None).cast("string").alias("only")).unionByName(fractions)
    spread = figures.select("*", F.explode(_cells_around(F.col("v"))).alias("cell"))
    probe = wanted.select("*", F.explode(F.array_distinct(_cell(F.col("value")))).alias("cell"))
    hits = probe.join(spread, "cell").where((F.col("only").isNull() | (F.col("only") == F.col("kind"))) & agrees(F.col("value"), F.col("v")))
    first = hits.groupBy("kind", "value").agg(F.min_by("figure", "position").alias("matched_value"))
    return claims.join(first, ["kind", "value"], "left")


def label_verdicts(numbers: DataFrame, labels: DataFrame) -> DataFrame:
    """Claims written right after the name of a metric, and whether they are that metric's value.

    *labels* is (label, expected).  A name is looked for as it is written, but for case; it may hold
    digits and any script, and no letter a-z may touch it.  The stretches of the words before a number that have
    a name's length are joined by equality, so the work does not grow with the number of names.
    """
    plain = labels.withColumn("label", F.lower("label"))
    lengths = sorted(r[0] for r in plain.where(F.length("label").between(1, _REACH)).select(F.length("label")).distinct().collect())  # at most _REACH
    spots = numbers.select("doc", "pos", "kind", "value", F.lower("near").alias("w")).where(F.length("w") > 0)
    # a digit between the name and the number breaks the bond
    spots = spots.withColumn("from", F.greatest(F.lit(1), F.length("w") - F.length(F.regexp_extract("w", r"(\P{Nd}*)\z", 1))))

    def letter(at: Column) -> Column:
        return F.substring("w", at, F.lit(1)).between("a", "z") & (at > 0)

    ends = F.filter(F.sequence(F.col("from"), F.length("w")), lambda j: ~letter(j + 1))
    runs = F.flatten(F.transform(ends, lambda j: F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: (k <= j) & ~letter(j - k)), lambda k: F.substring("w", j - k + 1, k))))
    named = spots.select("doc", "pos", "kind", "value", F.explode(F.array_distinct(runs)).alias("label"))
    joined = named.join(plain, "label").withColumn("ok", agrees(F.col("value"), F.col("expected")) | agrees(F.col("value"), F.col("expected") * 100))
    per = joined.groupBy("doc", "pos", "kind", "value", "label").agg(F.bool_or("ok").alias("ok"), F.min(F.when(F.col("ok"), F.col("expected"))).alias("matched"))
    longest = per.groupBy("doc", "pos", "kind", "value").agg(F.max_by(F.struct("label", "ok", "matched"), F.struct(F.length("label"), F.col("label"))).alias("b"))
    return longest.groupBy("doc", "kind", F.round("value", 4).alias("value")).agg(
        F.max_by("b", F.struct(F.col("b.ok").cast("int"), -F.col("pos"))).alias("b")).select(
        "doc", "kind", "value", F.col("b.label").alias("label"), F.col("b.ok").alias("satisfied"), F.col("b.matched").alias("label_value"))


def check_texts(docs: DataFrame, doc: str, text: str, known: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Every claim with its source: by name when one is written, else by size."""
    numbers = material_numbers(docs, doc, text)
    out = match_figures(distinct_claims(numbers), known)
    if labels is not None:
        out = out.join(label_verdicts(numbers, labels), ["doc", "kind", "value"], "left")
    else:
        out = out.withColumns({"label": F.lit(None).cast("string"), "satisfied": F.lit(None).cast("boolean"), "label_value": F.lit(None).cast("double")})
    bound = F.col("satisfied").isNotNull()
    matched = F.when(bound, F.col("label_value")).otherwise(F.col("matched_value"))
    verified = F.when(bound, F.col("satisfied")).otherwise(F.col("matched_value").isNotNull())
    return out.select("doc", "pos", "raw", "kind", "value", "times", "label", matched.alias("matched_value"), verified.alias("verified"),
                      F.when(~verified, "unverified").when(bound, "semantic").otherwise("magnitude").alias("basis"))


def verdicts(docs: DataFrame, doc: str, checked: DataFrame, traces: int = 10) -> DataFrame:
    """One row per text: claims, coverage, status and the first traces."""
    first = Window.partitionBy("doc").orderBy(F.desc(F.col("verified").cast("int")), "pos")
    shown = checked.withColumn("k", F.row_number().over(first))
    trace = F.when(F.col("verified") & (F.col("k") <= traces), F.struct("pos", "raw", "matched_value", "basis"))
    per = shown.groupBy("doc").agg(F.count(F.lit(1)).alias("claims"), F.count_if("verified").alias("verified"), F.count_if(F.col("basis") == "semantic").alias("semantic"),
                                   F.array_sort(F.collect_list(trace)).alias("traces"))
    share = F.coalesce(F.col("verified") / F.nullif(F.col("claims"), F.lit(0)), F.lit(1.0))
    out = docs.select(F.col(doc).alias("doc")).join(per, "doc", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("claims", "verified", "semantic")})
    return out.select("doc", "claims", "verified", "semantic", F.round(share, 3).alias("coverage"),
                      F.when(F.col("claims") == 0, "none").when(F.col("claims") == F.col("verified"), "clean").when(share >= 0.8, "partial").otherwise("weak").alias("status"), "traces")


# --- exact roundings, citations, signs ----------------------------------------


def forms(v: Column) -> Column:
    """Every exact rounding a figure may be printed in, its sign dropped or not."""
    def one(x: Column) -> list[Column]:
        return [F.bround(x, 4), *[F.bround(x, n) for n in (0, 1, 2)], *[F.bround(significant(x, n), 4) for n in (2, 3, 4)]]

    return F.array_distinct(F.transform(F.array(*one(v), *one(F.abs(v))), lambda x: (x + 0.0).cast("decimal(38,4)").cast("string")))


def exact_matches(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims that are an exact rounding of a figure; the earlier figure owns a shared form."""
    owner = known.select("position", "key", "figure", F.explode(forms(F.col("figure"))).alias("form")).groupBy("form").agg(
        F.min_by(F.struct("key", "figure"), "position").alias("o"))
    printed = (F.bround("value", 4) + 0.0).cast("decimal(38,4)").cast("string")
    found = claims.select("kind", "value", printed.alias("form")).distinct().join(owner, "form").select("kind", "value", "o")
    exact = F.round(F.abs(F.col("o.figure")), 2) == F.round(F.abs("value"), 2)
    return claims.join(found, ["kind", "value"], "left").select(
        *claims.columns, F.col("o.key").alias("figure_key"), F.when(F.col("o").isNull(), "unverified").when(exact, "exact").otherwise("rounded").alias("basis"))


def render_citations(docs: DataFrame, doc: str, text: str, displays: DataFrame) -> DataFrame:
    """Texts with every ``{{key}}`` replaced by its figure, and the unknown keys.

    *displays* is (key, display).  A text is cut at its tokens, these are
    looked up by key, and all pieces are put together again in order.
    """
    cut = docs.select(F.col(doc).alias("doc"), F.posexplode(_pieces(F.col(text), TOKEN.replace("(", "(?:", 1))).alias("i", "piece"))
    tokens = cut.where("i % 2 = 1").select("doc", "i", F.regexp_extract("piece", TOKEN, 1).alias("key")).join(displays.select("key", "display"), "key", "left")
    joined = tokens.unionByName(cut.where("i % 2 = 0"), allowMissingColumns=True)
    missing = F.when(F.col("key").isNotNull() & F.col("display").isNull(), F.col("key"))
    shown = F.when(F.col("key").isNull(), F.col("piece")).otherwise(F.coalesce("display", F.concat(F.lit("[figure unavailable: "), "key", F.lit("]"))))
    pieces = F.array_sort(F.collect_list(F.struct("i", shown.alias("t"))))
    return joined.groupBy("doc").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"), F.array_sort(F.collect_set(missing)).alias("unknown"))


def wrong_signs(docs: DataFrame, doc: str, text: str, known: DataFrame) -> DataFrame:
    """Change verbs before a figure that carries a minus already ("fell by -5")."""
    found = docs.select(F.col(doc).alias("doc"), F.posexplode(F.regexp_extract_all(text, F.lit(CHANGE_VERB), F.lit(0))).alias("i", "phrase"))
    keyed = found.select("doc", "i", F.trim(F.regexp_extract("phrase", CHANGE_VERB, 1)).alias("verb"), F.regexp_extract("phrase", CHANGE_VERB, 2).alias("key"))
    return keyed.join(known.where("figure < 0").select("key", "figure"), "key").select("doc", "i", "verb", "key", "figure")


def uncited_values(docs: DataFrame, doc: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """"What it's worth" lines that cite no figure of a change; of *known* (``key``), only those count as figures."""
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.regexp_extract_all(text, F.lit(WORTH_LINE), F.lit(1))).alias("i", "line"))
    cited = lines.select("doc", "i", F.explode_outer(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(1))).alias("key"))
    if known is not None:
        cited = cited.join(known.select(F.col("key").alias("figure_key")).distinct(), F.col("key") == F.col("figure_key"), "left").select("doc", "i", F.col("figure_key").alias("key"))
    k = F.col("key")
    worth = k.startswith("scn_") | k.endswith("_change") | F.contains(k, F.lit("_effect")) | k.endswith("_loss") | k.isin(WORTH_KEYS)
    counts = cited.groupBy("doc", "i").agg(F.count("key").alias("keys"), F.coalesce(F.bool_or(worth), F.lit(False)).alias("worth"))
    return counts.where(~F.col("worth")).select("doc", "i", F.when(F.col("keys") == 0, "no figure cited").otherwise("cites a level").alias("problem"))
