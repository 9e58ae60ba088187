"""Personal data: high-recall generators, boosted trees over their candidates, calibrated thresholds.

Base patterns (e-mail, address, card, phone) are always kept.  Wider generators propose further, overlapping spans: e-mail
addresses that are spelt out, every run of digits and the signs found in numbers, and the parts of such a run between blanks.  Each
candidate that is clear of base spans is judged once for every kind it might be.

The trees learn from spans whose truth is known.  Right are base spans of the corpus as they stand and damaged in ways that a
rule does not forgive: the plus sign or the country code left out, the check digit broken, digits grouped, "@" and "." spelt out.
Wrong are the same spans for every other kind, with a part cut off or a number added, and plain numbers in their place (identifiers,
dates, amounts, lists).  The features leave out what the base rules test (check digits, ranges, the leading plus), so the trees learn
shape and context.  By kind, the threshold is the least score with the precision asked for on spans held out by row.

All of it is column expressions, joins, and the tree learner that comes with Spark: no Python in the tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelspark.llm.storage import write_table

# The kinds in their order, and the base patterns.  Possessive repeats and look-behinds only save time: a match
# starts where a run of its first characters starts, or right after the match before.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "spelt": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "number": r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}  # texts without it cannot match
CONTEXT = 24  # characters kept before a candidate
CUES = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|credit|visa|pay", "phone": "tel|phone|call|mobil|fax"}

TREES, DEPTH = 12, 5
BINS = 256  # split points of a feature; more than the values that features of numbers and addresses take
PRECISION = 0.98  # on the held-out examples of a kind; below it nothing of the kind is added
LEAST_DIGITS = 7  # of a number that is judged
MOST_PARTS = 6  # parts between blanks that are proposed together, besides the whole run


def _cut(text: Column, pattern: str) -> Column:
    """The matches of a text: array of (gap before it, match, characters before, characters after)."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # zipped, so that the text is cut once and not for every match
    gaps = F.zip_with(found, parts, lambda m, gap: F.struct(m.alias("match"), gap.alias("gap")))
    both = F.zip_with(gaps, F.slice(parts, F.lit(2), F.lit(1 << 30)), lambda g, rest: F.struct(
        F.length(g["gap"]).alias("gap"), g["match"].alias("match"), F.right(g["gap"], F.lit(CONTEXT)).alias("before"),
        F.left(rest, F.lit(2)).alias("after")))
    return F.filter(both, lambda b: b["match"].isNotNull())


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the check-digit rule."""
    places = F.split(F.reverse(number), "")
    values = F.transform(places, lambda c, i: F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1)) * c.cast("int"))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(digits(match))
    parts = F.filter(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3)
    in_range = (F.size(parts) == 4) & F.forall(parts, lambda p: p.cast("int") <= 255)
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", in_range)
            .when(kind == "card", F.when(n.between(14, 19), luhn(digits(match))).otherwise(F.lit(False)))
            .when(kind == "phone", n.between(10, 15)).otherwise(F.lit(False)))


def _matches(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row and doc_id of every document row; row, generator, start, end, match, before, after."""
    text = F.col(text_column)
    has_digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<gap:int,match:string,before:string,after:string>>")

    def when_needed(name: str, pattern: str) -> Column:
        needed = F.contains(text, F.lit(NEEDS[name])) if name in NEEDS else F.lit(True)
        if name == "spelt":
            needed = text.rlike(r"@|\(at\)|\[at\]")
        elif name != "email":
            needed = needed & has_digit
        return F.coalesce(F.when(needed, _cut(text, pattern)), none).alias(name)

    generators = BASE | WIDE
    found = docs.select(F.col(id_column).cast("long").alias("doc_id"), *[when_needed(g, p) for g, p in generators.items()])
    found = write_table(found.withColumn("row", F.monotonically_increasing_id()), "pii_matches")
    # Positions are running sums of gaps and matches: over rows, so a text with very many matches is no array fold.
    one = lambda g: found.where(F.size(g) > 0).select("row", F.lit(g).alias("generator"), F.posexplode(g).alias("i", "m"))
    spans = reduce(DataFrame.unionByName, [one(g) for g in generators]).select("row", "generator", "i", "m.*")
    so_far = Window.partitionBy("row", "generator").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    spans = spans.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("match"))
    return found.select("row", "doc_id"), write_table(spans.drop("gap", "i"), "pii_spans")


def _proposals(spans: DataFrame) -> DataFrame:
    """row, run, first, parts, generator, start, end, match, before, after of all candidates.

    A run of numbers is proposed whole, and in all sequences of up to ``MOST_PARTS`` of its parts between blanks: ``first`` is the
    first part, ``parts`` their number.  A text of nothing but digits gives a few candidates for each part.
    """
    spelt = spans.where("generator = 'spelt'").select("row", F.col("start").alias("run"), F.lit(0).alias("first"), F.lit(1).alias("parts"),
                                                      "generator", "start", "end", "match", "before", "after")
    runs = spans.where("generator = 'number'")
    whole = runs.select("row", F.col("start").alias("run"), F.lit(0).alias("first"), F.size(F.split("match", "\\x20")).alias("parts"),
                        "generator", "start", "end", "match", "before", "after")
    parts = runs.where(F.contains("match", F.lit(" "))).select("row", F.col("start").alias("run"), "before", "after", F.posexplode(F.split("match", "\\x20")).alias("i", "part"))
    inside = Window.partitionBy("row", "run").orderBy("i")
    earlier = F.sum(F.length("part") + 1).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("start", (F.col("run") + F.coalesce(earlier, F.lit(0))).cast("int"))
    parts = parts.withColumns({f"part_{k}": F.lead("part", k).over(inside) for k in range(1, MOST_PARTS + 1)} | {"part_0": F.col("part"), "last": F.lag("part").over(inside)})
    sequences = []
    for k in range(1, MOST_PARTS + 1):
        match, follower = F.concat_ws(" ", *[F.col(f"part_{j}") for j in range(k)]), F.col(f"part_{k}")
        sequences.append(F.when(F.col(f"part_{k - 1}").isNotNull(), F.struct(
            F.lit(k).alias("parts"), match.alias("match"),
            F.when(follower.isNull(), F.col("after")).otherwise(F.left(F.concat(F.lit(" "), follower), F.lit(2))).alias("after"))))
    before = F.when(F.col("i") == 0, F.col("before")).otherwise(F.concat("last", F.lit(" ")))
    cut = parts.select("row", "run", F.col("i").alias("first"), "start", before.alias("before"), F.explode(F.array_compact(F.array(*sequences))).alias("s"))
    cut = cut.select("row", "run", "first", "s.parts", F.lit("number").alias("generator"), "start",
                     (F.col("start") + F.length("s.match")).alias("end"), "s.match", "before", "s.after")
    number = whole.unionByName(cut).dropDuplicates(["row", "start", "end"])
    number = number.where((F.length(digits(F.col("match"))) >= LEAST_DIGITS) & F.col("match").rlike("^[+(]?[0-9].*[0-9]$")
                          & ~F.col("after").rlike("^[A-Za-z0-9]"))
    return spelt.unionByName(number)


def _features(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context of each candidate, for each kind that it might be."""
    m, before = F.regexp_replace("match", r"^\+", ""), F.lower("before")
    numbers = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
    lengths = F.transform(numbers, F.length)
    count = lambda pattern: F.regexp_count(m, F.lit(pattern))
    columns = {
        "n_digits": F.length(digits(m)), "n_groups": F.size(numbers), "longest": F.coalesce(F.array_max(lengths), F.lit(0)),
        "shortest": F.coalesce(F.array_min(lengths), F.lit(0)), "n_length": F.length(m),
        "n_dots": count(r"\."), "n_spaces": count(r"\x20"), "n_dashes": count("-"), "n_brackets": count(r"[()]"),
        "n_letters": count("[A-Za-z]"), "n_at": count(r"@|\(at\)|\[at\]"),
        "before_word": before.rlike(r"[a-z]\W*$").cast("int"), "before_comma": before.rlike(r",\s*$").cast("int"),
        "before_digit": before.rlike(r"[0-9][\x20().+-]{0,3}$").cast("int"), "after_digit": F.col("after").rlike(r"^[\x20().+-]?[0-9]").cast("int"),
        "line_start": (F.trim(before) == "").cast("int"), "after_space": F.col("after").rlike(r"^\s|^$").cast("int"),
    }
    for kind in KINDS:
        columns[f"cue_{kind}"] = before.rlike(CUES[kind]).cast("int")
    wide = candidates.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    wide = wide.where((F.col("generator") == "spelt") == (F.col("kind") == "email"))
    for kind in KINDS:
        columns[f"is_{kind}"] = (F.col("kind") == kind).cast("int")
    return wide.withColumns({k: v.cast("double") for k, v in columns.items()}), list(columns)


def examples(base: DataFrame) -> DataFrame:
    """row, origin, truth, generator, match, before, after: spans whose truth is known, made from base spans (row, kind, start, match,
    before, after).  ``truth``: the kind, or null for what is none."""
    own, number = F.col("match"), digits(F.col("match"))
    chance = F.pmod(F.xxhash64("row", "start", "kind"), F.lit(10**12))
    day, month, year = (F.lpad((F.pmod(chance, F.lit(n)) + 1).cast("string"), 2, "0") for n in (28, 12, 30))

    def right(kind: str, origin: str, match: Column) -> Column:
        return F.when(F.col("kind") == kind, F.struct(F.lit(origin).alias("origin"), F.col("kind").alias("truth"), match.alias("match"),
                                                      F.col("before").alias("before"), F.col("after").alias("after")))

    def wrong(origin: str, match: Column, before: Column | None = None, after: Column | None = None, kind: str | None = None) -> Column:
        made = F.struct(F.lit(origin).alias("origin"), F.lit(None).cast("string").alias("truth"), match.alias("match"),
                        (F.col("before") if before is None else before).alias("before"), (F.col("after") if after is None else after).alias("after"))
        return F.when((F.col("kind") == kind) if kind else (F.col("kind") != "email"), made)

    grouped = lambda sign: F.regexp_replace(number, r"([0-9]{4})(?=[0-9])", f"$1{sign}")
    made = F.array_compact(F.array(
        *[right(kind, "plain", own) for kind in KINDS],
        right("email", "spelt", F.replace(F.replace(own, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) "))),
        right("email", "spelt", F.replace(own, F.lit("@"), F.lit("[at]"))),
        right("phone", "no plus", F.regexp_replace(own, r"^\+", "")),
        right("phone", "no country", F.regexp_replace(own, r"^\+[0-9]{1,3}[\x20.-]+", "")),
        right("phone", "dotted", F.regexp_replace(F.regexp_replace(own, r"^\+", ""), r"[\x20().-]+", ".")),
        right("card", "check digit", F.concat(F.substr(own, F.lit(1), F.length(own) - 1), ((F.right(own, F.lit(1)).cast("int") + 1) % 10).cast("string"))),
        right("card", "grouped", grouped(" ")), right("card", "grouped", grouped("-")),
        # a part cut off, and a number added
        wrong("cut", F.regexp_replace(own, r"^[+(]?[0-9]+[\x20().-]+", ""), before=F.concat(F.regexp_extract(own, r"^([+(]?[0-9]+[\x20().-]+)", 1)), kind="phone"),
        wrong("cut", F.regexp_replace(own, r"[\x20().-]+[0-9]+$", ""), after=F.left(F.regexp_extract(own, r"([\x20().-]+[0-9]+)$", 1), F.lit(2)), kind="phone"),
        wrong("cut", F.regexp_replace(grouped(" "), r"\x20[0-9]+$", ""), after=F.lit(" 1"), kind="card"),
        wrong("cut", F.regexp_replace(grouped(" "), r"^[0-9]+\x20", ""), before=F.concat(F.left(number, F.lit(4)), F.lit(" ")), kind="card"),
        wrong("merged", F.concat(own, F.lit(" "), F.left(number, F.lit(8)))),
        wrong("merged", F.concat(own, F.lit(" "), chance.cast("string"))),
        # plain numbers
        wrong("identifier", F.lpad((chance % 10**9).cast("string"), 7, "1")), wrong("identifier", F.lpad(chance.cast("string"), 12, "1")),
        wrong("long", F.concat(number, chance.cast("string"))),
        wrong("date", F.concat(F.lit("20"), year, F.lit("-"), month, F.lit("-"), day)), wrong("date", F.concat(day, F.lit("."), month, F.lit(".20"), year)),
        wrong("time", F.concat(F.lit("20"), year, month, day, F.lit("-"), day, month, F.lit("00"))),
        wrong("amount", F.regexp_replace(F.lpad((chance % 10**9).cast("string"), 9, "1"), r"([0-9]{3})(?=[0-9])", "$1.")),
        wrong("decimal", F.concat((chance % 100).cast("string"), F.lit("."), F.lpad((chance % 10**8).cast("string"), 8, "3"))),
        wrong("list", F.concat(F.lit("20"), year, F.lit(" 20"), month, F.lit(" 20"), day)),
        wrong("list", F.concat((chance % 1000).cast("string"), F.lit("-"), (chance % 9973).cast("string"), F.lit("-"), (chance % 997).cast("string"))),
    ))
    made = base.select("row", F.explode(made).alias("e")).select("row", "e.*")
    spelt = F.col("match").rlike(r"@|\(at\)|\[at\]")
    made = made.withColumn("generator", F.when(spelt, "spelt").otherwise("number"))
    # what the generators would not propose is no example
    return made.where(spelt | (F.length(digits(F.col("match"))) >= LEAST_DIGITS) & F.col("match").rlike("^[+(]?[0-9].*[0-9]$"))


class Judge:
    """The trees, and by kind the threshold with its precision and recall on held-out examples."""

    def __init__(self, base: DataFrame):
        wide, self.names = _features(examples(base))
        label = F.coalesce(F.col("kind") == F.col("truth"), F.lit(False)).cast("double")
        wide = wide.withColumn("label", label).withColumn("held_out", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(4)) == 0)
        # All examples, equal ones as one row with their number as weight: features are small whole numbers, so rows are few.
        counts = wide.groupBy("kind", "label", "held_out", *self.names).agg(F.count(F.lit(1)).cast("double").alias("weight"))
        every = write_table(counts, "pii_examples")
        counted = {r["label"]: r["n"] for r in every.where("not held_out").groupBy("label").agg(F.sum("weight").alias("n")).collect()}
        self.model: GBTClassificationModel | None = None
        self.thresholds: dict[str, float] = {}
        self.measured: dict[str, tuple[float, float]] = {}
        if min(counted.get(0.0, 0), counted.get(1.0, 0)) < 2:
            return
        assemble = VectorAssembler(inputCols=self.names, outputCol="features")
        learner = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=1, maxMemoryInMB=64)
        self.model = learner.fit(assemble.transform(every.where("not held_out").select("label", "weight", *self.names)))
        scored = _score(self.model, every.where("held_out"), self.names)
        step = scored.groupBy("kind", F.floor(F.col("score") * 100).alias("step")).agg(
            F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all"))
        found: dict[str, list] = {}
        for r in step.orderBy("kind", F.desc("step")).collect():  # 101 steps at most for each kind
            found.setdefault(r["kind"], []).append((r["step"], r["good"], r["all"]))
        for kind, steps in found.items():
            good = passed = 0
            total = sum(g for _, g, _ in steps)
            for at, g, n in steps:
                good, passed = good + g, passed + n
                if at >= 50 and total and good / passed >= PRECISION:
                    self.thresholds[kind], self.measured[kind] = at / 100, (good / passed, good / total)

    def judge(self, proposed: DataFrame) -> DataFrame | None:
        """The candidates whose best kind passes its threshold, with kind and score; None where nothing can be learned."""
        if not self.thresholds:
            return None
        wide, _ = _features(proposed)
        keys = ["row", "run", "first", "parts", "start", "end", "kind"]
        scored = _score(self.model, wide.select(*keys, *self.names), self.names)
        passes = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("score") >= t) for k, t in self.thresholds.items()])
        best = scored.where(passes).groupBy(*keys[:-1]).agg(F.max(F.struct("score", "kind")).alias("b"))
        return best.select(*keys[:-1], "b.kind", "b.score")


def _score(model: GBTClassificationModel, rows: DataFrame, names: list[str]) -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    return scored.withColumn("score", vector_to_array("probability")[1])


def _best_of_overlapping(judged: DataFrame) -> DataFrame:
    """Of overlapping candidates of a run the best: highest score, then the longest, then the earliest."""
    rank = F.struct("score", (F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("at"))
    covering = judged.withColumn("rank", rank).withColumn("part", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
    tops = covering.groupBy("row", "run", "part").agg(F.max("rank").alias("top"))
    won = covering.join(tops, ["row", "run", "part"]).where("rank = top")
    return won.groupBy("row", "start", "end", "kind", "parts").count().where("count = parts").select("row", "start", "end", "kind")


def _clear_of(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that overlap no base span."""
    both = candidates.withColumn("base", F.lit(False)).unionByName(
        base.select("row", "start", "end", F.lit(True).alias("base")), allowMissingColumns=True)
    # running values in both directions: a frame that ends with the partition would be read anew for every row
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(
        Window.partitionBy("row").orderBy("start", F.desc("base"), "end").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(
        Window.partitionBy("row").orderBy(F.desc("start"), "base", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.coalesce(reached, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    return both.withColumn("clear", ~F.col("base") & clear).where("clear").drop("clear", "base")


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row: doc_id, found: array of (start, end, kind, base), by start, then kind, base spans first.

    Positions count code points, ends are exclusive.  A null text is an empty one and has no spans; null ids stay.  Texts are read whole,
    however long.  Repeated rows each get their own result; further columns are ignored; an empty table gives no rows.  Without
    examples of both sorts (or below the precision asked for) only base spans are returned.  Added spans overlap no other span.
    """
    rows, spans = _matches(docs, id_column, text_column)
    named = spans.where(F.col("generator").isin(*KINDS)).where(valid(F.col("generator"), F.col("match")))
    kept = write_table(named.select("row", F.col("generator").alias("kind"), "start", "end", "match", "before", "after"), "pii_base")
    proposed = write_table(_clear_of(kept, _proposals(spans)), "pii_candidates")
    judged = Judge(kept).judge(proposed)
    all_spans = kept.select("row", "start", "end", "kind", F.lit(True).alias("base"))
    if judged is not None:
        added = _best_of_overlapping(write_table(judged, "pii_judged")).withColumn("base", F.lit(False))
        all_spans = _without_overlaps(all_spans.unionByName(added))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    packed = F.sort_array(F.collect_list(F.struct("start", place.alias("place"), (~F.col("base")).alias("added"), "end", "kind")))
    listed = all_spans.groupBy("row").agg(packed.alias("found"))
    found = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,place:int,added:boolean,end:int,kind:string>>")),
                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (~s["added"]).alias("base")))
    return rows.join(listed, "row", "left").select("doc_id", found.alias("found"))


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> dict[str, tuple[float, float, float]]:
    """By kind: threshold, and precision and recall on held-out examples."""
    _, spans = _matches(docs, id_column, text_column)
    named = spans.where(F.col("generator").isin(*KINDS)).where(valid(F.col("generator"), F.col("match")))
    judge = Judge(write_table(named.select("row", F.col("generator").alias("kind"), "start", "end", "match", "before", "after"), "pii_base"))
    return {kind: (t, *judge.measured[kind]) for kind, t in judge.thresholds.items()}


def _without_overlaps(spans: DataFrame) -> DataFrame:
    """Leave out added spans that overlap a base span, or an added one that starts earlier."""
    earlier = Window.partitionBy("row").orderBy("start", F.desc("base"), "end").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), "base", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(later)
    clear = (F.coalesce(F.max("end").over(earlier), F.lit(-1)) <= F.col("start")) & (F.coalesce(next_base, F.col("end")) >= F.col("end"))
    return spans.withColumn("clear", F.col("base") | clear).where("clear").drop("clear")
