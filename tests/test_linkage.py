import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from linkwright.functions import similarity as S
from linkwright.functions import text as X
from linkwright.operators import blocking, candidates, evaluation, features, model, training
from linkwright.operators.normalize import addresses, entities_normalized, names
from linkwright.sources import tsv


def one(spark, expression, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expression(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, X.strip_accents, "Léarning Center Àmicale") == "Learning Center Amicale"
    assert one(spark, X.clean, "<< Team   Ecole! >>") == "team ecole"
    assert one(spark, X.alphanumeric, "Roberts Titan, Inc. #123") == "robertstitaninc123"
    df = spark.createDataFrame([("Zeta Alpha Beta",)], "t string").select(X.clean(F.col("t")).alias("c"))
    assert df.select(X.sorted_distinct(X.words(F.col("c")))).first()[0] == "alpha beta zeta"
    assert df.select(X.char_ngrams(F.col("c"))).first()[0][:3] == [" ze", "zet", "eta"]
    assert one(spark, X.transliterate, "plain  text ") == "plain  text "
    found = one(spark, X.transliterate, "राम मार्केटिंग प्राइवेट लिमिटेड")
    assert all(w in found for w in ("private", "limited", "ram"))
    assert "constructions" in one(spark, X.transliterate, "વિજય કન્સ્ટ્રક્શન્સ")
    for label, want in (("usa", "US"), ("france", "France"), ("germany", "Germany"), ("new zealand-x", "New Zealand-X"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("  ", "")):
        assert one(spark, X.country, label) == want


def view(spark, f, column, value):
    return f(spark.createDataFrame([(value,)], f"{column} string")).first()[-1]


@pytest.mark.parametrize(
    ("name", "core", "suffix"),
    [
        ("Acme Technologies Pvt Ltd", "acme technologies", "pvt ltd"),
        ("LLC Moncada Learning Center", "moncada learning center", "llc"),
        ("Zetaflux DBA: Fowler Peak Optics", "fowler peak optics", ""),
        ("siiainvestments.com", "siiainvestments", ""),
        ("Marina Ecole France SARL", "marina ecole france", "sarl"),
        ("Shree Akash Traders", "sh traders", ""),
        ("Ltd", "ltd", "ltd"),
        (None, "", ""),
    ],
)
def test_names(spark, name, core, suffix):
    got = view(spark, names, "business_name", name)
    assert (got.core_name, got.legal_suffix) == (core, suffix)


def test_addresses(spark):
    got = view(spark, addresses, "business_address", "123 Main St, Houston, TX")
    assert {"street", "tx"} <= set(got.tokens) and got.numeric_tokens == ["123"] and got.building_number == "123"
    assert {"tx", "court"} <= set(view(spark, addresses, "business_address", "5780 Fawn Ct, Fort Worth, Texas").tokens)
    assert view(spark, addresses, "business_address", "KH NO. -570/13, New Delhi, DL 110001").postal_code == "110001"
    assert view(spark, addresses, "business_address", "00303 x").numeric_tokens == ["303"]
    empty = view(spark, addresses, "business_address", None)
    assert empty.is_empty and empty.tokens == [] and empty.cleaned == ""


def brute_jaro_winkler(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    other = [b[j] for j in sorted(used)]
    t = sum(x != y for x, y in zip(mine, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_similarities_match_brute_force():
    import random

    rng = random.Random(3)
    a, b = (["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 12))) for _ in range(500)] for _ in range(2))
    assert all(math.isclose(x, brute_jaro_winkler(s, t), abs_tol=1e-12) for x, s, t in zip(S.jaro_winkler_of(a, b), a, b))
    assert S.longest_common_subsequence(a, b).tolist() == [brute_lcs(s, t) for s, t in zip(a, b)]


def test_similarity_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"], "apple", "application", "b a", "a b")], "x array<string>, y array<string>, p string, q string, s string, t string")
    c = F.col
    row = df.select(S.jaccard(c("x"), c("y")), S.overlap(c("x"), c("y")), S.prefix(c("p"), c("q")), S.token_sort_ratio(c("s"), c("t")), S.levenshtein(c("p"), F.lit("")), S.levenshtein(F.lit(""), F.lit("")), S.prefix(F.lit(""), F.lit(""))).first()
    assert [round(v, 9) for v in row] == [round(1 / 3, 9), 0.5, round(4 / 11, 9), 1.0, 0.0, 1.0, 0.0]


TRAIN = [
    (1, "S1-1", "Harbor Lantern Corp", "17 Quay St, Tacoma, WA", "US"),
    (1, "S1-2", "Nilgiri Spices Pvt Ltd", "8 Lake Road, Mysore", "India"),
    (1, "S1-3", "Lonely Kiln", "402 Birch Ave, Tulsa, OK", "US"),
    (1, "S1-4", "Copper Finch Inc", "91 7th Ave, Denver, CO", "US"),
    (1, "S1-5", "Pune Dental House", "33 Fort Road, Pune, Maharashtra", "India"),
    (1, "S1-6", "Willow Metrics", "6 Ash St, Albany, NY", "US"),
    (2, "S2-10", "Harbor Lantern Corporation", "17 Quay Street, Tacoma, Washington", "US"),
    (2, "S2-20", "Nilgiri Spices", "8 Lake Rd, Mysore, Karnataka", "India"),
    (2, "S2-40", "Copper Finch", "91 Seventh Avenue, CO", "US"),
    (2, "S2-50", "Pune Dental House Pvt Ltd", "33 Fort Rd, Pune", "India"),
    (2, "S2-99", "Nothing Alike Co", "750 Mill Way, Fresno", "US"),
    (3, "S3-10", "Harbor Lantern Incorporated", "17 Quay St, Tacoma", "US"),
    (3, "S3-40", "Copper Finch Works", "91 7th Ave, Denver", "US"),
    (3, "S3-99", "Static Corp", "1200 Canal Blvd, Fresno", "US"),
]
TRUTH = {"S1-1": "S2-10,S3-10", "S1-2": "S2-20", "S1-3": "", "S1-4": "S2-40,S3-40", "S1-5": "S2-50", "S1-6": ""}
TEST = [
    (1, "S1-T1", "Harbor Lantern Corp", "17 Quay St, Tacoma, WA", "US"),
    (1, "S1-T2", "Atelier Verrier Nantais SARL", "5 Rue des Halles, Nantes", "France"),
    (1, "S1-T3", "Lonely Inc", "12 Birch Dr, Tulsa", "US"),
    (2, "S2-T10", "Harbor Lantern Corporation", "17 Quay Street, Tacoma, Washington", "US"),
    (2, "S2-T20", "Atelier Verrier Nantais", "5 R. DES HALLES, NANTES", "France"),
    (3, "S3-T10", "Harbor Lantern Inc", "17 Quay St, Tacoma", "US"),
    (3, "S3-T20", "Cercle du Lac", "44 Place Verte", "France"),
]


@pytest.fixture(scope="module")
def linked(spark):
    rows = [(i, *r) for i, r in enumerate(TRAIN)]
    records = spark.createDataFrame(rows, "ingest_seq long, source int, entity_id string, business_name string, business_address string, country string")
    s1, targets = blocking.sides(entities_normalized(records).cache())
    truth = spark.createDataFrame([(k, m) for k, v in TRUTH.items() for m in v.split(",") if m], "s1_id string, target_id string")
    return s1, targets, truth, s1.select(F.col("entity_id").alias("s1_id"))


def pairs(df):
    return {(r.s1_id, r.target_id) for r in df.collect()}


def test_blocking_and_recall(spark, linked):
    s1, targets, truth, asked = linked
    assert ("S1-1", "S2-10") in pairs(blocking.exact_core(s1, targets)) == pairs(blocking.exact_union(s1, targets)) | set()
    assert ("S1-4", "S3-40") in pairs(blocking.by_token(s1, targets))
    assert not pairs(blocking.by_token(s1, targets, cap=0))
    foreign = targets.withColumn("ckey", F.lit("france"))
    assert not pairs(blocking.exact_union(s1, foreign)) and not pairs(blocking.by_token(s1, foreign))
    assert ("S1-1", "S3-10") in pairs(blocking.by_address(s1, targets))
    found = candidates.top_candidates(candidates.union_with_provenance(s1, targets, enable_tfidf=True), 10)
    row = candidates.recall(found, truth, asked, targets).first()
    assert row.candidate_recall == 1.0 and row.total_s1 == 6 and row.total_gt_pairs == 6
    assert pairs(training.missed_positives(found, truth, targets)) == set()
    own = training.training_pairs(found, truth, asked, targets).collect()
    assert {(r.s1_id, r.target_id) for r in own if r.label} == pairs(truth)
    assert {r.s1_id for r in own if not r.label} == set(TRUTH)


def brute_similarity(s1, targets, least, top):
    def grams(r):
        out = []
        for w in f"{r.name.core_name} {r.address.cleaned}".lower().split():
            w = f" {w} "
            for n in (3, 4):
                out += [w[i : i + n] for i in range(max(len(w) - n + 1, 1))]
                if len(w) <= n:
                    break
        return out

    a, b = ({r.entity_id: grams(r) for r in df.collect()} for df in (s1, targets))
    df: dict = {}
    for g in b.values():
        for x in set(g):
            df[x] = df.get(x, 0) + 1

    def unit(g):
        v = {x: (1 + math.log(g.count(x))) * (math.log((1 + len(b)) / (1 + df[x])) + 1) for x in set(g) if x in df}
        n = math.sqrt(sum(w * w for w in v.values())) or 1
        return {x: w / n for x, w in v.items()}

    out = {}
    for i, g in a.items():
        u = unit(g)
        scores = sorted(((round(sum(w * unit(h).get(x, 0) for x, w in u.items()), 9), j) for j, h in b.items()), key=lambda t: (-t[0], t[1]))
        out |= {(i, j): s for s, j in [t for t in scores if t[0] >= least][:top]}
    return out


def test_similarity_join_matches_brute_force(linked):
    s1, targets, _, _ = linked
    for least, top in ((0.25, 20), (0.1, 2), (0.6, 5)):
        got = {(r.s1_id, r.target_id): r.similarity for r in blocking.by_similarity(s1, targets, least, top).collect()}
        want = brute_similarity(s1, targets, least, top)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_features(linked):
    s1, targets, truth, _ = linked
    rows = features.pair_features(truth, s1, targets).collect()
    assert len(features.ALL) == 39 and len(rows) == 6
    assert all(r[f] is not None and not math.isnan(r[f]) for r in rows for f in features.ALL)
    lantern = next(r for r in rows if r.target_id == "S2-10")
    assert lantern.name_exact_core == 1 and lantern.country_match == 1 and lantern.addr_levenshtein > 0.7 and lantern.gen_count == 0


def test_metrics(spark):
    schema = "s1_id string, target_id string"
    predicted = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("c", "q")], schema)
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "p")], schema)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    each = {r.s1_id: (round(r.precision, 3), r.recall, round(r.f05, 3)) for r in evaluation.entity_f05(predicted, truth, asked).collect()}
    assert each == {"a": (0.667, 1.0, 0.714), "b": (1.0, 1.0, 1.0), "c": (0.0, 0.0, 0.0)}
    row = evaluation.macro_f05(predicted, truth, asked).first()
    assert row.macro_f05 == round((0.7142857 + 1) / 3, 5) and row.singleton_count == 1 and row.singleton_accuracy == 1.0
    totals = evaluation.error_totals(predicted, truth, asked).first()
    assert (totals.total_tp_pairs, totals.total_fp_pairs, totals.total_fn_pairs) == (2, 2, 1)
    scored = predicted.withColumn("prob", F.when(F.col("target_id") == "z", 0.3).otherwise(0.8))
    sweep = {r.threshold: r.macro_f05 for r in evaluation.threshold_sweep(scored, truth, asked).collect()}
    assert len(sweep) == 36 and sweep[0.15] < sweep[0.31] == sweep[0.79] and sweep[0.81] < sweep[0.79]
    assert evaluation.best_threshold(evaluation.threshold_sweep(scored, truth, asked)).first().threshold == 0.31


def write(path, header, rows):
    path.write_text("\n".join("\t".join(map(str, r)) for r in [header, *rows]) + "\n", encoding="utf-8")


def folders(tmp_path):
    head = ("entity_id", "business_name", "business_address", "country")
    for kind, rows in (("train", TRAIN), ("test", TEST)):
        (tmp_path / kind).mkdir()
        for k in (1, 2, 3):
            write(tmp_path / kind / f"{kind}_source{k}.tsv", head, [r[1:] for r in rows if r[0] == k])
    write(tmp_path / "train" / "train_ground_truth.tsv", ("source1_entity_id", "matched_entity_ids"), TRUTH.items())


def test_scans_and_truth(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('business_name\tentity_id\tbusiness_address\tcountry\n Ab "c \tS1-1\t1 St\tUS\n\nB\tS1-2\nC\tS1-3\t\tindia\n', encoding="utf-8")
    got = tsv.read_records(spark, str(path)).orderBy("ingest_seq").collect()
    assert [(r.entity_id, r.business_name, r.country) for r in got] == [("S1-1", 'Ab "c', "US"), ("S1-2", "B", ""), ("S1-3", "C", "india")]
    assert [r.entity_id for r in tsv.read_records(spark, str(path), country="INDIA").collect()] == ["S1-3"]
    assert [r.entity_id for r in tsv.read_records(spark, str(path), max_records=1).collect()] == ["S1-1"]
    truth = tmp_path / "t.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\na\tx, y,x,\nb\t\nc\na\tz\nd\tS2-250, S3-11,S2-22\n", encoding="utf-8")
    assert {r.s1_id: r.matches for r in tsv.parse_truth(tsv.read_truth_lines(spark, str(truth))).collect()} == {"a": ["z"], "b": [], "c": [], "d": ["S2-22", "S2-250", "S3-11"]}


def test_results_and_validation(spark, tmp_path):
    required = spark.createDataFrame([(0, "S1-1"), (1, "S1-2")], "ingest_seq long, entity_id string")
    found = spark.createDataFrame([("S1-1", "S3-20"), ("S1-1", "S2-10")], "s1_id string, target_id string")
    rows, cand = tsv.matching_rows(required, found), tsv.matching_rows(required, found, "candidate_entity_ids")
    tsv.write_rows(rows, str(tmp_path / "m.tsv"), single_file=True)
    (part,) = (tmp_path / "m.tsv").glob("part-*")
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-10,S3-20\nS1-2\t\n"
    assert tsv.validate(rows, cand, required).count() == 0
    less = tsv.matching_rows(required, found.filter("target_id = 'S3-20'"), "candidate_entity_ids")
    assert [r.problem for r in tsv.validate(rows, less, required).collect()] == ["not in candidate_pairs"]
    assert {r.problem for r in tsv.validate(rows.limit(1), cand, required.filter("ingest_seq = 1")).collect()} == {"missing id", "unknown id"}
    tsv.write_rows(rows.repartition(2), str(tmp_path / "parts.tsv"))
    (tmp_path / "src" / "in").mkdir(parents=True)
    (tmp_path / "src" / "in" / "a.py").write_text("x = 1\n")
    (tmp_path / "doc.md").write_text("# doc\n")
    names = tsv.package(spark, str(tmp_path / "z.zip"), str(tmp_path), str(tmp_path / "src"), str(tmp_path / "doc.md"))
    assert names[0] == "output/m.tsv" and names[-2:] == ["code/in/a.py", "doc.md"] and all(n.startswith("output/parts.tsv") for n in names[1:-2])
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.namelist() == names and z.read("output/m.tsv") == part.read_bytes() and z.read("doc.md") == b"# doc\n"


def test_split_is_exact_and_disjoint(spark):
    ids = spark.range(1003).select(F.concat(F.lit("S1-"), "id").alias("s1_id"))
    got = training.split(ids, 0.2).collect()
    assert len(got) == 1003 and sum(r.is_train for r in got) == int(1003 * 0.8)


def test_first_rows_of_each_group(spark):
    import random

    from linkwright.plans.heads import marked

    rng = random.Random(2)
    rows = [(k, i, f"{k}-{i}") for k, ids in ((1, rng.sample(range(10**6), 700)), (2, [5, 2**62, 7, -3]), (None, range(0, 900, 3))) for i in ids]
    df = spark.createDataFrame(rows, "source int, ingest_seq long, name string").repartition(5)
    for n in (0, 1, 3, 4, 250, 10_000):
        want = {r[2] for k in (1, 2, None) for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])[:n]}
        assert {r.name for r in marked(df, "source", "ingest_seq", n, "head").filter("head").collect()} == want
    assert marked(df.limit(0), "source", "ingest_seq", 3, "head").count() == 0
    plan = marked(df, "source", "ingest_seq", 250, "head")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_spare_negatives_are_the_first_targets_that_are_no_match(spark):
    targets = spark.createDataFrame([(f"t{i}", 2 + i // 6, i) for i in range(12)], "entity_id string, source int, ingest_seq long")
    truth = spark.createDataFrame([("a", "t0"), ("a", "t1"), ("a", "t3"), ("b", "t2"), ("c", "t0")], "s1_id string, target_id string")
    none = spark.createDataFrame([], "s1_id string, target_id string, gen_exact boolean, gen_token boolean, gen_tfidf boolean, gen_address boolean, gen_count int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    got = {r.s1_id: r.target_id for r in training.training_pairs(none, truth, asked, targets).filter("label = 0").collect()}
    assert got == {"a": "t2", "b": "t0", "c": "t1", "d": "t0"}


def test_quoted_fields(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""b"" c"\t1 St\tUS\n', encoding="utf-8")
    assert tsv.read_records(spark, str(path), quoted=True).first().business_name == 'A "b" c'
    assert tsv.read_records(spark, str(path)).first().business_name == '"A ""b"" c"'


def test_calibrators_are_saved_with_the_model(spark, tmp_path):
    import random

    from pyspark.ml import PipelineModel

    rng = random.Random(4)
    df = spark.createDataFrame([(p, int(rng.random() < p * p)) for p in (rng.random() for _ in range(300))], "prob double, label int")
    for method in ("sigmoid", "isotonic"):
        fitted = model.Calibrator(method).fit(df)
        path = str(tmp_path / method)
        model.save(PipelineModel([]), path, model.Metadata(0.3), spark, fitted)
        _, meta, loaded = model.load(path, spark)
        assert meta.optimal_threshold == 0.3
        assert [r.prob for r in loaded.apply(df).collect()] == [r.prob for r in fitted.apply(df).collect()]


def test_calibration(spark):
    import random

    rng = random.Random(1)
    rows = [(p, int(rng.random() < p * p)) for p in (rng.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "prob double, label int")
    for method in ("sigmoid", "isotonic"):
        out = model.Calibrator(method).fit(df).apply(df)
        gap = out.agg(F.avg(F.col("prob") - F.col("label"))).first()[0]
        assert abs(gap) < 0.05 and out.filter("prob < 0 or prob > 1").count() == 0
    assert model.Calibrator().fit(df.limit(5)).apply(df.limit(5)).collect() == df.limit(5).collect()
    assert model.ranking_figures(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "prob double, label int")) == {"roc_auc": 0.5, "average_precision": round(0.5 + 0.5 * 2 / 3, 4)}
    ties = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(60)]
    ones, zeros = [p for p, y in ties if y], [p for p, y in ties if not y]
    area = sum((p > q) + (p == q) / 2 for p in ones for q in zeros) / (len(ones) * len(zeros))
    assert model.ranking_figures(spark.createDataFrame([(p, int(y)) for p, y in ties], "prob double, label int"))["roc_auc"] == round(area, 4)


def test_end_to_end(spark, tmp_path):
    from linkwright.plans.resolve import DEFAULTS, Resolver, load_config

    folders(tmp_path)
    config = load_config()
    assert config == DEFAULTS and config is not DEFAULTS
    config["data"] |= {"train_dir": str(tmp_path / "train"), "test_dir": str(tmp_path / "test"), "val_fraction": 0.33}
    config["blocking"] |= {"max_candidates_per_s1": 10, "enable_tfidf": False}
    config["model"] |= {"n_estimators": 4, "learning_rate": 0.3, "min_child_samples": 1, "neg_pos_ratio": 2.0, "save_model_path": str(tmp_path / "model"), "score_mode": "raw"}
    config["output"] |= {"output_dir": str(tmp_path / "out"), "single_file": True, "zip": str(tmp_path / "results.zip")}
    resolver = Resolver(spark, config)
    report = resolver.profile(str(tmp_path / "reports" / "profile.json"))
    assert report["ground_truth"]["singletons_zero_matches"] == 2 and report["train_source1.tsv"]["total_records"] == 6
    assert json.loads((tmp_path / "reports" / "profile.json").read_text()) == report
    assert "## train_source1.tsv" in (tmp_path / "reports" / "profile.md").read_text()
    figures = resolver.train()
    assert 0 <= figures["macro_f05"] <= 1 and 0 <= figures["roc_auc"] <= 1 and 0 <= figures["average_precision"] <= 1
    rows, cand = Resolver(spark, config).resolve()
    assert [r.source1_entity_id for r in rows.orderBy("ingest_seq").collect()] == ["S1-T1", "S1-T2", "S1-T3"]
    assert "S2-T20" in {r.source1_entity_id: r.candidate_entity_ids for r in cand.collect()}["S1-T2"]
    assert len(list((tmp_path / "out" / "matching_results.tsv").glob("part-*"))) == 1
    with zipfile.ZipFile(tmp_path / "results.zip") as z:
        assert set(z.namelist()) == {"output/matching_results.tsv", "output/candidate_pairs.tsv"}


def test_stream_of_targets(spark, linked, tmp_path):
    from linkwright.streaming.incremental import match_stream

    s1, _, _, _ = linked
    rows = [(i, *r) for i, r in enumerate(TRAIN) if r[0] > 1]
    batch = spark.createDataFrame(rows, "ingest_seq long, source int, entity_id string, business_name string, business_address string, country string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = set()
    match_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), s1, lambda df, _: got.update(pairs(df)), str(tmp_path / "checkpoint")).awaitTermination()
    assert ("S1-1", "S2-10") in got and ("S1-2", "S2-20") in got


def test_reports(spark, linked, tmp_path):
    from linkwright.plans.experiments import blocking_report, controlled_recall, error_report

    _, _, truth, asked = linked
    rows = [(i, *r) for i, r in enumerate(TRAIN)]
    records = spark.createDataFrame(rows, "ingest_seq long, source int, entity_id string, business_name string, business_address string, country string")
    row = controlled_recall(records, truth, 1).first()
    assert row.total_s1 == 4 and row.total_gt_pairs == 6 and row.candidate_recall == 1.0
    report = blocking_report(records, truth, asked, enable_tfidf=False)
    assert report["union"]["recalled_gt_pairs"] == 6 and report["strategies"]["union"]["recalled"] == 6
    predicted = spark.createDataFrame([("S1-1", "S2-10"), ("S1-1", "S2-99"), ("S1-3", "S3-99")], "s1_id string, target_id string")
    errors = error_report(predicted, truth, asked, records, str(tmp_path))
    assert errors["aggregate"]["total_fp_pairs"] == 2 and errors["aggregate"]["total_fn_pairs"] == 5
    assert [r["target_id"] for r in errors["samples"]["false_positive_pairs"]] == ["S2-99"]
    assert json.loads((tmp_path / "error_analysis.json").read_text()) == errors and (tmp_path / "error_analysis.md").exists()
