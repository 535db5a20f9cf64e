"""End to end: profile, train and validate, resolve. One plan for all countries: the country is a join key."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators import blocking, candidates, evaluation, features, model, profile, training
from linkwright.operators.normalize import entities_normalized
from linkwright.plans.staging import exists, staged, write_text
from linkwright.sources import tsv

DEFAULTS = {
    "random_seed": 42,
    "data": {"train_dir": "data/train", "test_dir": "data/test", "val_fraction": 0.15, "sample_size_train": 20_000, "sample_size_targets": 120_000},
    "blocking": {"max_candidates_per_s1": 45, "enable_tfidf": True, "tfidf_min_similarity": 0.25, "tfidf_top_k": 20},
    "model": {"learning_rate": 0.05, "n_estimators": 320, "max_depth": 5, "min_child_samples": 20, "neg_pos_ratio": 3.0, "save_model_path": "experiments/er_model", "calibration": "sigmoid", "score_mode": "calibrated"},
    "output": {"output_dir": "output", "reports_dir": "reports", "single_file": False, "zip": None, "code_dir": None, "documentation": None},
}


def load_config(path: str | None = None) -> dict:
    """Defaults with the sections of a YAML (if there is a YAML parser) or JSON file laid over them."""
    config = copy.deepcopy(DEFAULTS)
    if path and Path(path).exists():
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                raise ValueError(f"{path}: there is no YAML parser here; write the configuration as JSON") from None
            own = yaml.safe_load(text) or {}
        else:
            own = json.loads(text)
        for k, v in own.items():
            if isinstance(v, dict) and isinstance(config.get(k), dict):
                config[k].update(v)
            else:
                config[k] = v
    return config


def match(s1: DataFrame, targets: DataFrame, classifier, threshold: float, limit: int = candidates.MAX_CANDIDATES, enable_tfidf: bool = False, calibrator: model.Calibrator | None = None, min_similarity: float = blocking.MIN_SIMILARITY, top_k: int = blocking.TOP_K) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) of normalized records. Matches come out of candidates, so they are a subset of them."""
    found = staged(candidates.best_candidates(s1, targets, limit, enable_tfidf, min_similarity, top_k), "candidates")
    scored = model.score(classifier, features.pair_features(found, s1, targets))
    scored = calibrator.apply(scored) if calibrator else scored
    return model.decide(scored, threshold), found


class Resolver:
    def __init__(self, spark: SparkSession, config: dict | None = None):
        self.spark, self.config = spark, config or load_config()
        self.classifier = self.calibrator = None
        self.threshold = 0.5

    def _records(self, kind: str) -> tuple[DataFrame, DataFrame]:
        folder = self.config["data"][f"{kind}_dir"]
        one, two, three = (tsv.read_records(self.spark, f"{folder}/{kind}_source{k}.tsv", k) for k in (1, 2, 3))
        return one, two.unionByName(three)

    def _blocking(self) -> tuple[bool, float, int]:
        b = self.config["blocking"]
        return b["enable_tfidf"], b["tfidf_min_similarity"], b["tfidf_top_k"]

    def profile(self, report: str | None = None) -> dict:
        """Profiles of all files there are; written as JSON if report names a file, and as Markdown beside it."""
        out = {}
        for kind in ("train", "test"):
            folder = self.config["data"][f"{kind}_dir"]
            truth = f"{folder}/{kind}_ground_truth.tsv"
            if exists(self.spark, truth):
                lines = tsv.read_truth_lines(self.spark, truth)
                out["ground_truth"] = profile.profile_truth(lines).first().asDict() | {"match_distribution": {str(r.matches): r.entities for r in profile.truth_histogram(lines).orderBy("matches").collect()}}
            for k in (1, 2, 3):
                name = f"{kind}_source{k}.tsv"
                if exists(self.spark, f"{folder}/{name}"):
                    records = tsv.read_records(self.spark, f"{folder}/{name}", k)
                    row = profile.profile_source(records).first()
                    out[name] = ({} if row is None else row.asDict()) | {"country_distribution": {r.country: r.records for r in profile.country_histogram(records).collect()}}
        if report:
            write_text(self.spark, report, json.dumps(out, indent=2, ensure_ascii=False))
            lines = ["# Profile"]
            for name, figures in out.items():
                lines += ["", f"## {name}", "", "| figure | value |", "| --- | --- |", *[f"| {k} | {', '.join(f'{a}: {b}' for a, b in v.items()) if isinstance(v, dict) else v} |" for k, v in figures.items()]]
            write_text(self.spark, report.removesuffix(".json") + ".md", "\n".join(lines) + "\n")
        return out

    def train(self) -> dict:
        """Fits classifier, calibrator and threshold on a sample of the training records; returns validation figures."""
        c = self.config
        s1, targets = self._records("train")
        s1 = s1.orderBy("ingest_seq").limit(c["data"]["sample_size_train"])
        truth = tsv.parse_truth(tsv.read_truth_lines(self.spark, f"{c['data']['train_dir']}/train_ground_truth.tsv"))
        truth = truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
        pairs = staged(tsv.truth_pairs(truth), "truth")
        targets = tsv.sample_targets(targets, pairs, c["data"]["sample_size_targets"] // 2)
        s1n, tn = staged(entities_normalized(s1), "s1"), staged(entities_normalized(targets), "targets")
        parts = staged(training.split(s1n.select(F.col("entity_id").alias("s1_id")), c["data"]["val_fraction"], c["random_seed"]), "split")
        found = staged(candidates.best_candidates(s1n, tn, c["blocking"]["max_candidates_per_s1"], *self._blocking()), "candidates")
        labelled = features.pair_features(training.training_pairs(found, pairs, parts, tn, c["model"]["neg_pos_ratio"]), s1n, tn)
        labelled = staged(labelled.join(parts, "s1_id"), "labelled")
        fit, val = labelled.filter("is_train"), labelled.filter("not is_train")
        m = c["model"]
        settings = model.ModelConfig(m["learning_rate"], m["n_estimators"], m["max_depth"], m["min_child_samples"], calibration=m["calibration"], seed=c["random_seed"])
        stop = val.select("label").distinct().count() == 2
        self.classifier = model.train(fit, settings, val if stop else None)
        self.calibrator = model.Calibrator(m["calibration"]).fit(staged(model.score(self.classifier, val).select("prob", "label"), "val-scores")) if m["score_mode"] == "calibrated" else None
        held = parts.filter("not is_train").select("s1_id")
        own = found.join(held, "s1_id", "left_semi")
        scored = model.score(self.classifier, features.pair_features(own, s1n, tn)).select("s1_id", "target_id", "prob")
        scored = staged(self.calibrator.apply(scored) if self.calibrator else scored, "scored")
        real = pairs.join(held, "s1_id", "left_semi")
        best = evaluation.best_threshold(evaluation.threshold_sweep(scored, real, held)).first()
        self.threshold = best.threshold
        chosen = scored.filter(F.col("prob") >= self.threshold)
        figures = evaluation.macro_f05(chosen, real, held).first().asDict() | {"threshold": self.threshold, "errors": evaluation.error_totals(chosen, real, held).first().asDict(), "recall": candidates.recall(own, real, held, tn).first().asDict()}
        figures |= model.ranking_figures(model.score(self.classifier, val).select("prob", "label"))
        model.save(self.classifier, m["save_model_path"], model.Metadata(self.threshold), self.spark, self.calibrator)
        return figures

    def resolve(self, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Matches and candidates of the test records, written as TSV after they were validated."""
        c = self.config
        if self.classifier is None:
            self.classifier, meta, self.calibrator = model.load(c["model"]["save_model_path"], self.spark)
            self.threshold = meta.optimal_threshold
        s1, targets = self._records("test")
        if limit:
            s1 = s1.orderBy("ingest_seq").limit(limit)
        s1n, tn = staged(entities_normalized(s1), "s1"), staged(entities_normalized(targets), "targets")
        enable, least, top = self._blocking()
        matches, found = match(s1n, tn, self.classifier, self.threshold, c["blocking"]["max_candidates_per_s1"], enable, self.calibrator, least, top)
        rows = staged(tsv.matching_rows(s1n, matches), "matching")
        cand = staged(tsv.matching_rows(s1n, found, "candidate_entity_ids"), "candidate-rows")
        problems = tsv.validate(rows, cand, s1n).limit(5).collect()
        if problems:
            raise ValueError(f"invalid results: {problems}")
        out, one = c["output"]["output_dir"], c["output"]["single_file"]
        tsv.write_rows(rows, f"{out}/matching_results.tsv", one)
        tsv.write_rows(cand, f"{out}/candidate_pairs.tsv", one)
        if c["output"]["zip"]:
            tsv.package(self.spark, c["output"]["zip"], out, c["output"]["code_dir"], c["output"]["documentation"])
        return rows, cand


def baseline(normalized: DataFrame, truth: DataFrame, asked: DataFrame) -> DataFrame:
    """Macro F of the exact join of country, core name and address."""
    s1, targets = blocking.sides(normalized)
    return evaluation.macro_f05(blocking.baseline_exact(s1, targets).distinct(), truth, asked)
