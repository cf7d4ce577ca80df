"""Company filings: nested JSON to facts, standard fields, and quarters derived from year-to-date values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import FIELDS, concept_table

# The forms that are read, and spans in days that make a period of so many months.
DEFAULT_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "10-KT", "10-KT/A", "10-QT", "10-QT/A")
MONTH_SPANS = {(70, 125): 3, (150, 210): 6, (230, 300): 9, (330, 390): 12}
DAYS_PER_MONTH = 365.25 / 12
QUARTER_GAP = (70, 125)

FACT_COLUMNS = ["ticker", "cik", "field", "concept", "unit", "period_start", "period_end", "period_months", "value", "fy", "fp", "form", "accn", "filed", "derived"]
RAW_COLUMNS = ["cik", "entity", "taxonomy", "concept", "unit", "period_start", "period_end", "value", "fy", "fp", "form", "accn", "filed"]

_ITEM = "struct<start:string,end:string,val:string,fy:string,fp:string,form:string,accn:string,filed:string>"
COMPANY_FACTS = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<units:map<string,array<{_ITEM}>>>>>>"


def format_cik_column(c: Column) -> Column:
    """A CIK as ten digits; null where it isn't up to ten digits."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(text.rlike("^[0-9]{1,10}$"), F.lpad(text, 10, "0"))


def parse_company_facts(payloads: DataFrame, concepts: list[str] | None = None, *, payload_col: str = "payload") -> DataFrame:
    """One JSON document per row -> one row per fact version, with the source order as ``ordinal``.

    ``concepts`` ("taxonomy:Concept") are chosen right after the maps are opened, before their items are. Items
    without an end, a value, an accession number or a filing date are left out. Other columns are carried along.
    """
    rest = [c for c in payloads.columns if c != payload_col]
    doc = payloads.select(*rest, F.from_json(payload_col, COMPANY_FACTS).alias("doc"))
    by_taxonomy = doc.select(*rest, "doc.cik", F.col("doc.entityName").alias("entity"), F.explode("doc.facts").alias("taxonomy", "named"))
    by_concept = by_taxonomy.select(*rest, "cik", "entity", "taxonomy", F.explode("named").alias("concept", "spec"))
    if concepts is not None:
        by_concept = by_concept.where(F.concat_ws(":", "taxonomy", "concept").isin(list(concepts)))
    by_unit = by_concept.select(*rest, "cik", "entity", "taxonomy", "concept", F.explode("spec.units").alias("unit", "items"))
    items = by_unit.select(*rest, "cik", "entity", "taxonomy", "concept", "unit", F.posexplode("items").alias("ordinal", "item"))
    day = lambda name: F.expr(f"try_cast(item.{name} AS date)")
    facts = items.select(
        *rest,
        format_cik_column(F.col("cik")).alias("cik"),
        "entity",
        "taxonomy",
        "concept",
        "unit",
        day("start").alias("period_start"),
        day("end").alias("period_end"),
        F.expr("try_cast(item.val AS double)").alias("value"),
        F.expr("try_cast(item.fy AS int)").alias("fy"),
        F.col("item.fp").alias("fp"),
        F.col("item.form").alias("form"),
        F.col("item.accn").alias("accn"),
        day("filed").alias("filed"),
        "ordinal",
    )
    return facts.dropna(subset=["period_end", "value", "accn", "filed"])


def period_months(start: Column, end: Column) -> Column:
    """A period's months: 0 without a start, the usual spans as 3, 6, 9 or 12, others rounded half to even."""
    days = F.datediff(end, start) + 1
    usual = [F.when(days.between(low, high), F.lit(n)) for (low, high), n in MONTH_SPANS.items()]
    return F.coalesce(*usual, F.bround(days / F.lit(DAYS_PER_MONTH)), F.lit(0)).cast("bigint")


def standardize_facts(raw: DataFrame, fields: list[str] | None = None, forms: tuple[str, ...] | None = DEFAULT_FORMS) -> DataFrame:
    """Raw facts with a ticker -> standard facts; within a filing and period a field's first concept present counts.

    Ties go to the earlier filing date, then to the source order (column ``ordinal`` if there is one). Facts of each
    CIK are chosen apart. An unknown field is a KeyError.
    """
    for f in fields or []:
        if f not in FIELDS:
            raise KeyError(f)
    known = raw if forms is None else raw.where(F.col("form").isin(list(forms)))
    if "ordinal" not in raw.columns:
        known = known.withColumn("ordinal", F.lit(0))
    dim = F.broadcast(concept_table(raw.sparkSession, fields))
    overridden = dim.where("only_ticker is not null").select("only_ticker", "field").distinct()
    named = known.withColumn("name", F.concat_ws(":", "taxonomy", "concept"))
    plain = dim.where("only_ticker is null").drop("only_ticker").withColumnsRenamed({"concept": "name", "unit": "want"})
    joined = named.join(plain, "name")
    own = dim.where("only_ticker is not null").withColumnsRenamed({"concept": "name", "unit": "want", "only_ticker": "ticker"})
    joined = joined.join(F.broadcast(overridden.withColumnRenamed("only_ticker", "ticker")), ["ticker", "field"], "left_anti")
    joined = joined.unionByName(named.join(own, ["name", "ticker"]).select(*joined.columns))
    fits = joined.where((F.col("unit") == F.col("want")) & ((F.col("kind") == "instant") == F.col("period_start").isNull()))
    ready = fits.withColumn("period_months", period_months(F.col("period_start"), F.col("period_end")))
    keys = ["ticker", "cik", "field", "accn", "period_end", "period_months"]
    first = W.partitionBy(*keys).orderBy("priority", "filed", "ordinal")
    best = ready.withColumn("place", F.row_number().over(first)).where("place = 1")
    return best.withColumn("concept", F.col("name")).withColumn("derived", F.lit(False)).select(*FACT_COLUMNS)


def quarantined(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): facts that end after they were filed, start after they end or have no finite value are bad."""
    finite = F.coalesce(~F.isnan("value") & (F.abs("value") != float("inf")), F.lit(False))
    late = F.coalesce(F.col("period_end") > F.col("filed"), F.lit(False))
    turned = F.coalesce(F.col("period_start") > F.col("period_end"), F.lit(False))
    bad = late | turned | ~finite
    return facts.where(~bad), facts.where(bad)


def derive_quarters(facts: DataFrame) -> DataFrame:
    """The facts and the single quarters that year-to-date values of one company imply.

    A value over 6, 9 or 12 months less the one exactly three months shorter with the same start, known by then and
    ending a quarter earlier, is the last quarter; values over other spans take no part. Of several shorter ones the
    same concept goes first, then the latest filing, then the greatest accession number. A reported quarter of the same
    filing stays before a derived one.

    No pairs are made: later and earlier values of a company, field, start and span are put in the order of their
    filing, and the best earlier one is the running maximum at the later one. An earlier value is there once for
    each distinct end of a later one that it precedes by a quarter, which is one as a rule.
    """
    additive = [name for name, spec in FIELDS.items() if spec.additive]
    usual = F.col("period_months").isin(sorted(MONTH_SPANS.values()))
    spans = facts.where(F.col("field").isin(additive) & F.col("period_start").isNotNull() & usual)
    n = F.col("period_months")
    roles = F.array(
        F.when(n >= 6, F.struct(n.alias("months"), F.lit(True).alias("asks"), F.col("period_end").alias("end"))),
        F.when(n <= 9, F.struct((n + 3).alias("months"), F.lit(False).alias("asks"), F.lit(None).cast("date").alias("end"))),
    )
    rows = spans.select(*FACT_COLUMNS, F.explode(F.array_compact(roles)).alias("role"))
    key = ["ticker", "cik", "field", "period_start", "role.months"]
    rows = rows.withColumn("ends", F.collect_set("role.end").over(W.partitionBy(*key)))
    ends = F.filter("ends", lambda e: F.datediff(e, "period_end").between(*QUARTER_GAP))
    rows = rows.withColumn("end", F.explode(F.when(F.col("role.asks"), F.array("role.end")).otherwise(ends)))
    earlier = F.when(~F.col("role.asks"), F.struct("filed", "accn", "period_end", "value"))
    order = [F.col("filed"), F.col("role.asks")]
    frame = (W.unboundedPreceding, W.currentRow)
    alike = F.max(earlier).over(W.partitionBy(*key, "end", "concept").orderBy(*order).rowsBetween(*frame))
    best = F.max(earlier).over(W.partitionBy(*key, "end").orderBy(*order).rowsBetween(*frame))
    found = rows.withColumns({"alike": alike, "best": best}).where(F.col("role.asks") & F.col("best").isNotNull())
    g = F.coalesce("alike", "best")
    made = found.withColumns({"g": g, "choice": F.struct(F.col("alike").isNotNull().alias("same"), g["filed"].alias("filed"), g["accn"].alias("accn"))})
    made = made.withColumns(
        {
            "span": F.col("period_months"),
            "period_months": F.lit(3).cast("bigint"),
            "period_start": F.date_add("g.period_end", 1),
            "value": F.col("value") - F.col("g.value"),
            "derived": F.lit(True),
        }
    )
    none = F.lit(None).cast(made.schema["choice"].dataType)
    every = facts.select(*FACT_COLUMNS, F.lit(None).cast("bigint").alias("span"), none.alias("choice"))
    every = every.unionByName(made.select(*FACT_COLUMNS, "span", "choice"))
    # of one filing's values over one span the best choice counts, then of all spans that end in the quarter the least
    version = ["ticker", "cik", "field", "accn", "period_end", "period_months"]
    of_span = F.row_number().over(W.partitionBy(*version, "derived", "span").orderBy(F.col("choice").desc()))
    every = every.withColumn("place", of_span).where(~F.col("derived") | F.col("span").isNull() | (F.col("place") == 1))
    first = W.partitionBy(*version).orderBy("derived", "choice")
    return every.withColumn("place", F.row_number().over(first)).where("place = 1").select(*FACT_COLUMNS)


def combine_entities(facts: DataFrame, current: DataFrame) -> DataFrame:
    """One version per ticker, field, period and accession number over all of a ticker's companies.

    The later filing goes first, then a reported value, then the ticker's current company (``current``: ticker, cik),
    then the greatest CIK.
    """
    now = current.select("ticker", F.col("cik").alias("__now"))
    joined = facts.join(F.broadcast(now), "ticker", "left")
    is_now = F.coalesce(F.col("cik") == F.col("__now"), F.lit(False))
    order = [F.col("filed").desc(), F.col("derived").asc(), is_now.desc(), F.col("cik").desc()]
    keys = ["ticker", "field", "period_end", "period_months", "accn"]
    best = joined.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return best.where("place = 1").select(*FACT_COLUMNS)


def fact_schema() -> T.StructType:
    day, text = T.DateType(), T.StringType()
    kinds = [text, text, text, text, text, day, day, T.LongType(), T.DoubleType(), T.IntegerType(), text, text, text, day, T.BooleanType()]
    return T.StructType([T.StructField(n, k) for n, k in zip(FACT_COLUMNS, kinds, strict=True)])
