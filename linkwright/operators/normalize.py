"""Views of names and addresses. Python sees accents alone, and before the views: above a chain of projections its function would make
Spark put the chain into one, with every step repeated for each use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import text as X
from linkwright.functions.tables import BUILDING, DBA, DOMAIN, LEGAL_FORMS, LEGAL_WORDS, POSTAL, STATES, STREET_WORDS


def _spaced(text: Column) -> Column:
    """Words two spaces apart and between single ones, so that " word " is found without look-around."""
    return F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))


def legal_pattern(phrases: list[str]) -> str:
    return " (?:" + "|".join(p.replace(" ", "  ") for p in phrases) + ") "


def _cleaned_name(df: DataFrame, name_col: str) -> DataFrame:
    """df with __name, the cleaned text that stands for a name."""
    after = lambda g: F.trim(F.regexp_extract("__t", "(?id)" + DBA, g))
    step = df.withColumn("__t", X.transliterate(F.coalesce(F.col(name_col), F.lit(""))))
    step = step.withColumn("__t", F.when(F.col("__t").rlike("(?id)" + DBA), F.when(after(2) != "", after(2)).otherwise(after(1))).otherwise(F.col("__t")))
    step = step.withColumn("__t", F.regexp_replace("__t", "(?i)" + DOMAIN, ""))
    step = step.withColumn("__t", F.when(F.startswith("__t", F.lit("www.")), F.substring("__t", 5, 1 << 30)).otherwise(F.col("__t")))
    return step.withColumn("__name", X.clean(F.col("__t"))).drop("__t")


def names(df: DataFrame, name_col: str = "business_name", out: str = "name") -> DataFrame:
    """df with a struct of the views of a name (original, cleaned, alphanumeric, tokens, sorted_tokens, deduped_tokens, core_name, legal_suffix, char_ngrams, has_indic).

    The text after a "doing business as" mark stands for the name, if there is any. Legal forms are taken out in their
    fixed order; a form that is left over as a single word stays in the tokens but not in the core.
    """
    return _name_views(_cleaned_name(df, name_col), name_col, out)


def _name_views(step: DataFrame, name_col: str, out: str) -> DataFrame:
    original = F.coalesce(F.col(name_col), F.lit(""))
    # forms: (text that is left, forms found), one form after the other
    left, found = _spaced(F.col("__name")), F.array().cast("array<string>")
    for k, (form, phrases) in enumerate(LEGAL_FORMS):
        pattern = legal_pattern(phrases)
        step = step.withColumn(f"__l{k}", left)
        found = F.concat(found, F.when(F.col(f"__l{k}").rlike(pattern), F.array(F.lit(form))).otherwise(F.array().cast("array<string>")))
        left = F.regexp_replace(f"__l{k}", pattern, " ")
    step = step.withColumn("__tokens", F.filter(F.split(left, " +"), lambda w: w != "")).withColumn("__found", found)
    rest = F.filter("__tokens", lambda w: X.lookup(LEGAL_WORDS, w).isNull())
    late = F.filter(F.transform("__tokens", lambda w: X.lookup(LEGAL_WORDS, w)), lambda s: s.isNotNull())
    core = F.when(F.size(rest) > 0, F.array_join(rest, " ")).otherwise(F.col("__name"))
    step = step.withColumn("__core", core)
    view = F.struct(
        original.alias("original"),
        F.col("__name").alias("cleaned"),
        F.regexp_replace("__name", "[^a-z0-9]", "").alias("alphanumeric"),
        F.col("__tokens").alias("tokens"),
        F.array_join(F.array_sort("__tokens"), " ").alias("sorted_tokens"),
        F.array_join(F.array_distinct("__tokens"), " ").alias("deduped_tokens"),
        F.col("__core").alias("core_name"),
        F.array_join(F.concat("__found", F.array_except(late, F.col("__found"))), " ").alias("legal_suffix"),
        X.char_ngrams(F.col("__core")).alias("char_ngrams"),
        X.has_indic(original).alias("has_indic"),
    )
    return step.withColumn(out, view).drop("__name", "__tokens", "__found", "__core", *[f"__l{k}" for k in range(len(LEGAL_FORMS))])


def _mapped(token: Column) -> Column:
    street = F.coalesce(X.lookup(STREET_WORDS, token), token)
    return F.coalesce(X.lookup(STATES, street), street)


def _cleaned_address(df: DataFrame, address_col: str) -> DataFrame:
    """df with __said, an address in Latin letters, and __address, the same cleaned."""
    raw = F.coalesce(F.col(address_col), F.lit(""))
    step = df.withColumn("__said", F.when(F.trim(raw) == "", F.lit("")).otherwise(X.transliterate(raw)))
    return step.withColumn("__address", X.clean(F.col("__said")))


def addresses(df: DataFrame, address_col: str = "business_address", out: str = "address") -> DataFrame:
    """df with a struct of the views of an address; a blank one is empty throughout."""
    return _address_views(_cleaned_address(df, address_col), address_col, out)


def _address_views(step: DataFrame, address_col: str, out: str) -> DataFrame:
    raw = F.coalesce(F.col(address_col), F.lit(""))
    blank = F.trim(raw) == ""
    step = step.withColumn("__tokens", F.transform(X.words(F.col("__address")), _mapped))
    joined = F.array_join("__tokens", " ")
    whole = F.transform(F.filter("__tokens", lambda w: w.rlike(r"^\d+$")), lambda w: F.when(w.rlike("^0+$"), F.lit("0")).otherwise(F.regexp_replace(w, "^0+", "")))
    view = F.struct(
        F.when(blank, F.lit("")).otherwise(raw).alias("original"),
        joined.alias("cleaned"),
        F.regexp_replace(joined, "[^a-z0-9]", "").alias("alphanumeric"),
        F.col("__tokens").alias("tokens"),
        X.sorted_distinct(F.col("__tokens")).alias("sorted_tokens"),
        whole.alias("numeric_tokens"),
        F.regexp_extract("__said", POSTAL, 0).alias("postal_code"),
        F.lower(F.regexp_extract("__said", "(?i)" + BUILDING, 1)).alias("building_number"),
        blank.alias("is_empty"),
    )
    return step.withColumn(out, view).drop("__said", "__address", "__tokens")


def entities_normalized(records: DataFrame) -> DataFrame:
    """records (entity_id, business_name, business_address, country, ...) with name, address, country_norm and the join key ckey."""
    cleaned = _cleaned_address(_cleaned_name(records, "business_name"), "business_address")
    out = _address_views(_name_views(cleaned, "business_name", "name"), "business_address", "address").withColumn("country_norm", X.country(F.col("country")))
    return out.withColumn("ckey", F.lower("country_norm"))
