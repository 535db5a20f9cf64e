"""The 39 features of a pair, in their fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions import similarity as S
from linkwright.plans.staging import staged

# Names and order of the features.
NAME = ["name_exact_clean", "name_exact_core", "name_exact_sorted", "name_exact_alpha", "name_token_jaccard", "name_token_overlap", "name_common_tokens_count", "name_char_jaccard", "name_levenshtein", "name_jaro_winkler", "name_token_sort_ratio", "name_prefix_sim", "name_len_diff_ratio", "name_token_count_diff"]
ADDRESS = ["addr_both_empty", "addr_one_empty", "addr_exact_clean", "addr_exact_sorted", "addr_exact_alpha", "addr_token_jaccard", "addr_token_overlap", "addr_common_tokens_count", "addr_levenshtein", "addr_numeric_overlap_count", "addr_postal_code_match", "addr_building_num_match", "addr_len_diff_ratio"]
INTERACTION = ["name_x_addr", "name_add_addr", "name_jacc_x_addr_jacc", "harmonic_sim", "both_exact_clean", "name_addr_disagreement", "country_match"]
PROVENANCE = ["gen_exact", "gen_token", "gen_tfidf", "gen_address", "gen_count"]
ALL = NAME + ADDRESS + INTERACTION + PROVENANCE
# The address features where both addresses are empty, and where one is.
BOTH_EMPTY = (1, 0, 1, 1, 1, 1, 1, 0, 1, 0, 0.5, 0.5, 0)
ONE_EMPTY = (0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1)

#: What features ask of a name and of an address.
NAME_VIEWS = ["cleaned", "core_name", "sorted_tokens", "alphanumeric", "tokens", "char_ngrams"]
ADDRESS_VIEWS = ["cleaned", "sorted_tokens", "alphanumeric", "tokens", "numeric_tokens", "postal_code", "building_number", "is_empty"]


def join_records(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs with the views of both records as structs l and r; pairs of unknown records are left out."""
    side = lambda df, key, name: df.select(F.col("entity_id").alias(key), F.struct("name", "address", "country_norm").alias(name))
    return pairs.join(side(s1, "s1_id", "l"), "s1_id").join(side(targets, "target_id", "r"), "target_id")


def _number(flag: Column) -> Column:
    return flag.cast("double")


def _length_gap(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def name_features(df: DataFrame) -> DataFrame:
    a, b = F.col("l.name"), F.col("r.name")
    own = [
        *[_number(a[k] == b[k]) for k in ("cleaned", "core_name", "sorted_tokens", "alphanumeric")],
        S.jaccard(a["tokens"], b["tokens"]), S.overlap(a["tokens"], b["tokens"]), _shared(a["tokens"], b["tokens"]),
        S.jaccard(a["char_ngrams"], b["char_ngrams"]), S.levenshtein(a["core_name"], b["core_name"]),
        S.jaro_winkler(a["core_name"], b["core_name"]), S.token_sort_ratio(a["cleaned"], b["cleaned"]), S.prefix(a["core_name"], b["core_name"]),
        _length_gap(a["core_name"], b["core_name"]), F.abs(F.size(a["tokens"]) - F.size(b["tokens"])).cast("double"),
    ]
    return df.select("*", *[c.alias(n) for n, c in zip(NAME, own, strict=True)])


def address_features(df: DataFrame) -> DataFrame:
    a, b = F.col("l.address"), F.col("r.address")

    def agree(field: str) -> Column:
        return F.when((a[field] != "") & (b[field] != ""), _number(a[field] == b[field])).otherwise(0.5)

    own = [
        F.lit(0.0), F.lit(0.0), *[_number(a[k] == b[k]) for k in ("cleaned", "sorted_tokens", "alphanumeric")],
        S.jaccard(a["tokens"], b["tokens"]), S.overlap(a["tokens"], b["tokens"]), _shared(a["tokens"], b["tokens"]),
        S.levenshtein(a["cleaned"], b["cleaned"]), _shared(a["numeric_tokens"], b["numeric_tokens"]),
        agree("postal_code"), agree("building_number"), _length_gap(a["cleaned"], b["cleaned"]),
    ]
    both, one = a["is_empty"] & b["is_empty"], a["is_empty"] | b["is_empty"]
    cases = [F.when(both, float(x)).when(one, float(y)).otherwise(c).alias(n) for n, c, x, y in zip(ADDRESS, own, BOTH_EMPTY, ONE_EMPTY, strict=True)]
    return df.select("*", *cases)


def interaction_features(df: DataFrame) -> DataFrame:
    nl, al, nj, aj = (F.col(c) for c in ("name_levenshtein", "addr_levenshtein", "name_token_jaccard", "addr_token_jaccard"))
    own = [nl * al, (nl + al) / 2, nj * aj, 2 * nl * al / (nl + al + 1e-6), F.col("name_exact_clean") * F.col("addr_exact_clean"), F.abs(nl - al), _number(F.lower("l.country_norm") == F.lower("r.country_norm"))]
    return df.select("*", *[c.alias(n) for n, c in zip(INTERACTION, own, strict=True)])


def provenance_features(df: DataFrame) -> DataFrame:
    """Flags and count as numbers, 0 where a pair is no candidate."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in PROVENANCE})


def pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs (s1_id, target_id, and provenance and further columns if there are any) with all features as doubles."""
    df = provenance_features(interaction_features(address_features(name_features(join_records(pairs, s1, targets)))))
    rest = [c for c in pairs.columns if c not in (*PROVENANCE, "s1_id", "target_id")]
    return df.select("s1_id", "target_id", *rest, *ALL)


def _name_views(df: DataFrame) -> DataFrame:
    return df.withColumn("__views", F.struct(*[f"name.{v}" for v in NAME_VIEWS]))


def numbered_names(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(no, name, country_norm), staged: the names of both sides, as features see them, each once."""
    both = _name_views(s1).select("__views", "country_norm").unionByName(_name_views(targets).select("__views", "country_norm"))
    return staged(both.distinct().select(F.monotonically_increasing_id().alias("no"), F.col("__views").alias("name"), "country_norm"), "names")


def with_number(df: DataFrame, names: DataFrame) -> DataFrame:
    """Records (entity_id, address) with no, the number of their name among names."""
    known = names.select("no", F.col("name").alias("__known"), F.col("country_norm").alias("__country"))
    both = _name_views(df).select("entity_id", "address", "country_norm", "__views")
    return both.join(known, both["__views"].eqNullSafe(F.col("__known")) & both["country_norm"].eqNullSafe(F.col("__country"))).select("entity_id", "address", "no")


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (l_no, r_no, ADDRESS, and others) with all features: names are compared once for each pair of them that meets."""
    view = lambda p: names.select(F.col("no").alias(f"{p}_no"), F.struct("name", "country_norm").alias(p))
    named = name_features(rows.select("l_no", "r_no").distinct().join(view("l"), "l_no").join(view("r"), "r_no"))
    named = staged(named.select("l_no", "r_no", *NAME, *[F.struct(F.col(f"{p}.country_norm").alias("country_norm")).alias(p) for p in "lr"]), "name-features")
    return provenance_features(interaction_features(rows.join(named, ["l_no", "r_no"])))


def named_pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, names: DataFrame) -> DataFrame:
    """pair_features, the same rows, for many pairs: these carry numbers of names, so each pair of names is compared once. names: numbered_names."""

    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        address = F.struct(F.struct(*[f"address.{v}" for v in ADDRESS_VIEWS]).alias("address")).alias(p)
        return with_number(df, names).select(F.col("entity_id").alias(key), address, F.col("no").alias(f"{p}_no"))

    met = pairs.join(side(s1, "s1_id", "l"), "s1_id").join(side(targets, "target_id", "r"), "target_id")
    met = staged(address_features(met).select(*pairs.columns, *ADDRESS, "l_no", "r_no"), "address-features")
    rest = [c for c in pairs.columns if c not in (*PROVENANCE, "s1_id", "target_id")]
    return with_names(met, names).select("s1_id", "target_id", *rest, *ALL)
