"""Text jobs over pages, documents and stored model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelspark import constants as C
from labelspark.functions.label_values import label_values
from labelspark.functions.markup import collapse, visible_texts
from labelspark.functions.names import contains_any
from labelspark.functions.plan import settle
from labelspark.operators.latest import pick


def page_text(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Visible text of whole pages, white space collapsed."""
    rows = settle(pages, {"_raw": visible_texts(F.col(markup))})
    return rows.withColumn("text", F.trim(collapse(F.col("_raw")))).drop(markup, "_raw")


def label_sections(rows: DataFrame, text: str, length: int | None = C.SECTION_LENGTH) -> DataFrame:
    """Replaces a collapsed, lower-cased text by ``_section`` and adds ``mix_type``.

    The section starts at the first heading in order of preference and ends at the earliest heading
    of the national mix; without the latter it is ``length`` characters long (None: to the end of the text).
    With only a national heading the text before it counts, with none the whole text.
    """
    kinds = F.array(*[F.lit(kind) for _, kind in C.SECTION_STARTS])
    def position(heading: str) -> Column:
        # a byte search first: most headings are absent, and counting characters is the slow part
        return F.when(F.col(text).contains(heading), F.instr(F.col(text), heading)).otherwise(0)

    rows = settle(rows, {
        "_starts": F.array(*[position(heading) for heading, _ in C.SECTION_STARTS]),
        "_stop": F.array_min(F.filter(F.array(*[position(s) for s in C.SECTION_STOPS]), lambda at: at > 0)),
    })
    rows = settle(rows, {"_start": F.get(F.filter("_starts", lambda at: at > 0), F.lit(0))})
    body, start, stop = F.col(text), F.col("_start"), F.col("_stop")
    section = (
        F.when(start.isNotNull() & (stop > start), F.substring(body, start, stop - start))
        .when(start.isNotNull(), F.substring(body, start, F.lit(length) if length is not None else F.length(body)))
        .when(stop.isNotNull(), F.substring(body, F.lit(1), stop - 1))
        .otherwise(body)
    )
    kind = F.when(start.isNotNull(), F.get(kinds, F.array_position("_starts", start).cast("int") - 1)).otherwise("unbekannt")
    return settle(rows, {"_section": section, "mix_type": kind}).drop(text, "_starts", "_start", "_stop")


def extraction_confidence(renewable: Column, fossil: Column, nuclear: Column, co2: Column, waste: Column) -> Column:
    """How much of a label was found, 0 to 100."""
    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    total = sum((F.coalesce(c, F.lit(0.0)) for c in (fossil, nuclear)), F.coalesce(renewable, F.lit(0.0)))
    score = (points(renewable > 0, 25) + points(fossil >= 0, 20) + points(nuclear >= 0, 15) + points(co2 > 0, 20)
             + points(waste >= 0, 10) + points(total.between(95, 105), 10))
    return F.least(F.lit(100), score)


def extract_labels(documents: DataFrame, default_year: int, text: str = "text",
                   section_length: int | None = C.SECTION_LENGTH) -> DataFrame:
    """One row per document that carries a label: year, shares, CO2, waste, mix type and confidence.

    Texts that cannot mention one of the three main shares carry no label and are left out first, by
    plain searches over the whole raw text.  White space, section and year of the others are found on
    the JVM; only their sections are handed to the Arrow function.
    """
    rows = settle(documents, {"_lower": F.lower(text)}).drop(text)
    rows = rows.filter(contains_any(F.col("_lower"), C.MAIN_SHARE_HINTS))
    rows = settle(rows, {"_lower": collapse(F.col("_lower"))})
    year = F.regexp_extract("_lower", C.LABEL_YEAR_PATTERN, 1).try_cast("int")
    rows = settle(rows, {"year": F.coalesce(year, F.lit(default_year))})
    # settled, so that the filter below does not run the Arrow function a second time
    rows = label_sections(rows, "_lower", section_length)
    # a label names one of its main shares and holds a percentage; no other section goes through Arrow
    main = [w for f in ("renewable", "fossil", "nuclear") for w in C.SHARE_KEYWORDS[f]]
    rows = rows.filter(F.col("_section").rlike(r"[0-9][.,]?[\s\p{IsWhite_Space}]*%") & contains_any(F.col("_section"), main))
    rows = settle(rows, {"_v": label_values("_section")}).drop("_section")
    v = {f: F.col(f"_v.{f}") for f in [*C.SHARE_KEYWORDS, "co2", "waste", "eeg_percentage"]}
    zero = F.lit(0.0)
    found = sum((F.when(F.coalesce(v[f], zero) != 0, 1).otherwise(0) for f in ("fossil", "nuclear")),
                F.when(F.coalesce(v["renewable"], zero) != 0, 1).otherwise(0)) > 0
    columns = {f: F.coalesce(c, zero) if f in ("renewable", "fossil", "nuclear", "co2", "waste") else c
               for f, c in v.items()}
    columns["confidence"] = extraction_confidence(v["renewable"], v["fossil"], v["nuclear"], v["co2"], v["waste"])
    columns["extraction_method"] = F.lit("regex")
    return rows.filter(found).withColumns(columns).drop("_v")


def cascade(candidates: DataFrame, key: str, minimum_length: dict[str, int], vetoed: DataFrame | None = None) -> DataFrame:
    """Per document the result of the first method that gave one.

    ``candidates`` has (key, method, rank, text_length, found, ...); a method whose text is not longer
    than its minimum is passed over.  ``vetoed`` holds (key, is_label, confidence) of a classifier; a
    document it firmly calls no label (confidence of 70 or more) is dropped.
    """
    ok = F.col("found")
    for method, length in minimum_length.items():
        ok = ok & ((F.col("method") != method) | (F.col("text_length") > length))
    rows = candidates.filter(ok)
    if vetoed is not None:
        firm = vetoed.filter(~F.col("is_label") & (F.col("confidence") >= 70)).select(key).distinct()
        rows = rows.join(firm, key, "left_anti")
    return pick(rows, key, "rank", [c for c in candidates.columns if c not in (key, "found")], newest=False)


def hash_duplicates(documents: DataFrame) -> DataFrame:
    """Contents held by several suppliers, one row per (hash, supplier) with the size of the group."""
    owners = documents.filter(F.col("file_hash").isNotNull()).groupBy("file_hash", "provider_id").agg(
        F.count(F.lit(1)).alias("documents"))
    groups = (
        owners.groupBy("file_hash")
        .agg(F.count("provider_id").alias("providers"), F.sum("documents").alias("copies"))
        .filter(F.col("providers") > 1)
    )
    return owners.join(groups, "file_hash")
