"""Secret scans: fixed patterns and character Markov models, in DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in the order they are listed, and their patterns. Group 1 of assign has 8 characters at least; a
#: run of 16 or 32 characters is one match of the open-ended pattern, so the length is asked for in the pattern.
BASE = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
)
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]{8,}$"
#: Candidates for the models: runs of at least 20 of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate is a secret when its mean log-likelihood ratio a character, random against ordinary, is above this.
THRESHOLD = 0.6

#: Labelled samples of ordinary identifiers; more are made by joining their parts in usual ways.
PARTS = (
    "get set add remove update delete create find load save read write open close start stop init build parse format "
    "user name id key value index count size list map file path url page item order date time event data table column row "
    "number string text message error result status type class object node tree graph edge link image color width height "
    "config option default current previous next first last max min total average session account customer product price "
    "address country language version request response server client handler manager service factory controller context "
    "is has with from to by for of the and or not all any new old main test example internal external public private static"
).split()


def random_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled random strings, from hashes of numbers: base64, lower-case hex and letters with digits."""
    n = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    text = F.base64(F.unhex(digest))
    kind = F.pmod("id", F.lit(3))
    plain = F.substring(F.regexp_replace(text, "[+/=]", ""), 1, 36)
    return n.select(F.when(kind == 0, F.substring(text, 1, 40)).when(kind == 1, F.substring(digest, 1, 40)).otherwise(plain).alias("s"))


def ordinary_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled ordinary identifiers, in snake, kebab, camel, constant and path form, some with a number."""
    words = F.array(*map(F.lit, PARTS))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    four = F.array(*(pick(k) for k in range(4)))
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(100)).cast("string")
    kind = F.pmod("id", F.lit(6))
    camel = F.array_join(F.transform(four, lambda w: F.initcap(w)), "")
    joined = (
        F.when(kind == 0, F.array_join(four, "_")).when(kind == 1, F.array_join(four, "-")).when(kind == 2, camel)
        .when(kind == 3, F.upper(F.array_join(four, "_"))).when(kind == 4, F.array_join(four, "/")).otherwise(F.concat(F.array_join(four, ""), number))
    )
    return spark.range(rows).select(joined.alias("s"))


def bigrams(samples: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of adjacent characters; at most the square of the alphabet's size reaches the driver."""
    pairs = samples.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p"))
    return {(r["p"][0], r["p"][1]): r["count"] for r in pairs.groupBy("p").count().collect()}


def ratio_table(spark: SparkSession, random: DataFrame | None = None, ordinary: DataFrame | None = None) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary), for a, b in ALPHABET, row by row, with add-one smoothing."""
    tables = []
    for samples in (random or random_samples(spark), ordinary or ordinary_samples(spark)):
        counts = bigrams(samples)
        totals = {a: sum(counts.get((a, b), 0) for b in ALPHABET) for a in ALPHABET}
        tables.append([log((counts.get((a, b), 0) + 0.5) / (totals[a] + 0.5 * len(ALPHABET))) for a in ALPHABET for b in ALPHABET])
    return [x - y for x, y in zip(*tables, strict=True)]


#: Matches whose places are summed up together; sums of these sums follow, so that work grows little faster than matches.
TOGETHER = 128


def with_matches(df: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    """df with name: the leftmost non-overlapping matches of a pattern, and name_gaps: what lies before each of them and
    after the last, null without a match. Columns of their own, so that each is made once."""
    df = df.withColumn(name, F.regexp_extract_all(column, F.lit(pattern), F.lit(0)))
    return df.withColumn(f"{name}_gaps", F.when(F.size(name) > 0, F.split(column, pattern, -1)))


def running(items: Column, length: Column, size: int) -> Column:
    """array<array<struct<at, item>>>: pieces of `size` items, each with the sum of lengths before it in its piece and,
    as a last entry without an item, the piece's whole sum."""
    nothing = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("struct<gap:int,m:string>").alias("item")))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)["at"]
        return F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last.alias("at"), x.alias("item")), F.struct((last + length(x)).alias("at"), F.lit(None).cast("struct<gap:int,m:string>").alias("item"))))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda k: F.slice(items, k * size + 1, F.lit(size)))
    return F.transform(pieces, lambda piece: F.aggregate(piece, nothing, add))


def places(found: Column, gaps: Column) -> Column:
    """array<struct<start, end, m>> of matches, in code points, end exclusive.

    What lies between matches and the matches themselves alternate, so running sums of their lengths are places. Sums
    run within pieces of TOGETHER matches, then over pieces.
    """
    steps = F.slice(F.zip_with(found, gaps, lambda m, gap: F.struct(F.length(gap).alias("gap"), m.alias("m"))), F.lit(1), F.size(found))
    nothing = F.array().cast("array<struct<start:int,end:int,m:string>>")
    pieces = running(steps, lambda x: x["gap"] + F.length(x["m"]), TOGETHER)
    before = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(p, -1)["at"])))
    placed = lambda p, start: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: F.struct((start + x["at"] + x["item"]["gap"]).alias("start"), (start + x["at"] + x["item"]["gap"] + F.length(x["item"]["m"])).alias("end"), x["item"]["m"].alias("m")))
    shifted = F.zip_with(pieces, before, lambda p, start: F.coalesce(placed(p, start), nothing))
    return F.when(F.size(found) > 0, F.flatten(shifted)).otherwise(nothing)


def blanked(text: Column, found: Column, gaps: Column, valid: Column | None = None) -> Column:
    """text with spaces in place of the matches, or of the valid ones, so that places stay."""
    fill = lambda m: F.repeat(F.lit(" "), F.length(m))
    cover = fill if valid is None else lambda m: F.when(valid(m), fill(m)).otherwise(m)
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(gaps, found, lambda gap, m: F.concat(gap, F.coalesce(cover(m), F.lit("")))), "")).otherwise(text)


def mean_ratio(s: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the adjacent characters of s, which is of ALPHABET."""
    code = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(code, F.lit(1), F.size(code) - 1), F.slice(code, F.lit(2), F.size(code) - 1), lambda a, b: F.element_at(table, a * len(ALPHABET) + b + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / F.size(pairs)


def spans_text(spans: Column) -> Column:
    """kind:start:end of array<struct<start, kind, end>>, by start, then kind, comma-joined; kind is its number."""
    names = F.array(*(F.lit(k) for k, _ in BASE), F.lit("markov"))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """One row (doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of docs.

    Base kinds are fixed patterns. The models add kind markov: runs of CANDIDATE in what base spans leave of the text,
    whose mean log-likelihood ratio, of a Markov model of random strings to one of ordinary identifiers, is over
    THRESHOLD. table: ratio_table(), trained on the built-in samples if not given. Null and empty texts have no
    spans, and the hash of an empty string. Repeated rows and null doc_ids are scanned each; extra columns are
    ignored. No row leaves its task and no Python runs on rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ratios = F.from_json(F.lit(str(table or ratio_table(spark))), "array<double>")
    valid = lambda m: F.regexp_extract(m, BASE[0][1], 1).rlike("^" + ASSIGN_VALUE)
    out = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("rest", F.col("text"))
    for kind, pattern in BASE:
        out = with_matches(out, "text", pattern, "found")
        own = places(F.col("found"), F.col("found_gaps"))
        out = out.withColumn(kind, F.filter(own, lambda x: valid(x["m"])) if kind == "assign" else own)
        out = with_matches(out, "rest", pattern, "found")
        out = out.withColumn("rest", blanked(F.col("rest"), F.col("found"), F.col("found_gaps"), valid if kind == "assign" else None))
    out = with_matches(out, "rest", CANDIDATE, "found")
    random = lambda x: mean_ratio(x["m"], ratios) > THRESHOLD
    out = out.select("doc_id", *(k for k, _ in BASE), F.filter(places(F.col("found"), F.col("found_gaps")), random).alias("markov"))
    number = lambda column, n: F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end")))
    out = out.withColumn("base", F.concat(*(number(k, n) for n, (k, _) in enumerate(BASE, 1))))
    return out.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k, _ in BASE),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", number("markov", len(BASE) + 1))).alias("spans"),
    )
