"""Command line of the quality checks.

Exit codes: 0 passed, 1 hard errors, 2 wrong arguments or unreadable input, 3 warnings under
--fail-on-warnings.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys

from pyspark.sql import SparkSession

from trackmill.plans.quality import PROFILES, SPLITS, THRESHOLDS, Checks, temporal_screens, write_report
from trackmill.sources.annotations import Dataset, category_split, known_filtered
from trackmill.sources.files import dataset_options, file_digests, filters_classes
from trackmill.sources.sinks import write_flags


#: Options that name inputs.
INPUTS = ("current", "original", "original_full", "validation", "category_split", "known_filtered_anchors", "training_config", "dataloader_source")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quality")
    p.add_argument("current")
    p.add_argument("--report", required=True)
    p.add_argument("--original")
    p.add_argument("--original-full")
    p.add_argument("--validation")
    p.add_argument("--category-split")
    p.add_argument("--known-filtered-anchors")
    p.add_argument("--training-config")
    p.add_argument("--reference-dir", help="folder in which references are looked for by name")
    p.add_argument("--dataloader-source", help="source that must filter by the class list")
    p.add_argument("--bbox-tolerance", type=float, default=1e-4, help="pixels by which boxes may differ")
    p.add_argument("--area-tolerance", type=float, default=1e-4, help="share by which areas may differ")
    p.add_argument("--sha256", action="store_true", help="digests of all inputs in the report")
    p.add_argument("--temporal-flags")
    p.add_argument("--temporal-diagnostics", action="store_true")
    p.add_argument("--fail-on-warnings", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--profile", choices=PROFILES, default="protocol-aware")
    p.add_argument("--split", choices=SPLITS, default="unspecified")
    p.add_argument("--max-examples", type=int, default=20)
    for name, value in THRESHOLDS.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=float, default=value, dest=f"t_{name}")
    return p


def _json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def described(spark: SparkSession, inputs: dict[str, str], digests: bool) -> dict[str, dict]:
    """Path and size of each input, and its digest where asked for."""
    out = {n: {"path": os.path.realpath(p), "size_bytes": os.path.getsize(p)} for n, p in inputs.items() if os.path.isfile(p)}
    if digests and out:
        found = {r.path: r.sha256 for r in file_digests(spark, sorted({d["path"] for d in out.values()})).collect()}  # a row per input
        out = {n: d | {"sha256": found[d["path"]]} for n, d in out.items()}
    return out


def found_references(folder: str | None) -> list[str]:
    """Documents of a folder that may be references, by name: those of training, base ones first."""
    listed = sorted(glob.glob(os.path.join(glob.escape(folder), "*train*.json"))) if folder else []
    return sorted(listed, key=lambda p: "base" not in os.path.basename(p).split("train", 1)[1])


def training_options(config: str, current: str, categories: list[tuple[str, str | None]]) -> dict:
    """What training reads, from a configuration and the class list it names; categories: (id, name) as
    the typed rows hold them."""
    with open(config, encoding="utf-8") as f:
        options = dataset_options(f.read(), os.path.basename(current)) or {}
    classes = options.get("classes")
    if isinstance(classes, str) and not os.path.isfile(classes):
        classes = os.path.join(os.path.dirname(config), classes)
    if not isinstance(classes, str) or not os.path.isfile(classes):
        return {}
    with open(classes, encoding="utf-8") as f:
        names = {line.strip() for line in f if line.strip()}
    sampler, refs = options.get("key_img_sampler") or {}, options.get("ref_img_sampler") or {}
    return {
        "confirmed": True,
        "allowed": [id_ for id_, name in categories if name is not None and name.startswith("s:") and name[2:] in names],
        "interval": sampler.get("interval", 1),
        "scope": refs.get("scope", 0),
        "original_only": bool(options.get("is_select_ori_img")),
        "extra_ratio": options.get("extra_sample_ratio", 0.0) or 0.0,
    }


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        a = arguments().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if (a.temporal_diagnostics or a.profile == "strict-raw") and not a.temporal_flags:
        print("--temporal-flags is needed for temporal screens", file=sys.stderr)
        return 2
    if min(a.bbox_tolerance, a.area_tolerance) < 0:
        print("tolerances must not be negative", file=sys.stderr)
        return 2
    references = found_references(a.reference_dir)
    if a.split == "base-only" and not a.original:
        a.original = next((p for p in references if "base" in os.path.basename(p)), a.original_full)
    inputs = {n: getattr(a, n) for n in INPUTS if getattr(a, n)}
    if {os.path.realpath(p) for p in (a.report, a.temporal_flags) if p} & {os.path.realpath(p) for p in inputs.values()}:
        print("an output would overwrite an input", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("quality").getOrCreate()
    try:
        options: dict = {}
        if a.category_split:
            options["split_pairs"], options["split_issues"] = category_split(_json(a.category_split))
        if a.known_filtered_anchors:
            options["manifest"], options["manifest_issues"] = known_filtered(_json(a.known_filtered_anchors))
        read = lambda p: Dataset.read(spark, p) if p else None
        current = read(a.current)
        if a.training_config and (not a.dataloader_source or filters_classes(a.dataloader_source)):
            listed = [tuple(c) for c in current.index("categories").select("id", "name").collect()] if a.split == "base-only" else []  # a row per class
            options["training"] = training_options(a.training_config, a.current, listed)
        checks = Checks(current, read(a.original), read(a.original_full), a.profile, a.split, validation=read(a.validation), verbose=a.verbose, tolerance=a.bbox_tolerance, area_tolerance=a.area_tolerance, **options)
        thresholds = {n: getattr(a, f"t_{n}") for n in THRESHOLDS}
        report = checks.report(a.max_examples, a.temporal_diagnostics, thresholds)
        report["inputs"] = described(spark, inputs, a.sha256)
        report["reference_selection"] = {"selected": a.original, "full": a.original_full, "candidates": references}
        report["parameters"] = {"split": a.split, "profile": a.profile, "bbox_tolerance": a.bbox_tolerance, "area_tolerance": a.area_tolerance, "sha256": a.sha256}
        os.makedirs(os.path.dirname(os.path.abspath(a.report)), exist_ok=True)
        write_report(report, a.report)
        if a.temporal_flags and (a.temporal_diagnostics or a.profile == "strict-raw"):
            write_flags(temporal_screens(checks.observations(), thresholds), a.temporal_flags)
    except Exception as e:  # unreadable or broken input
        print(f"quality: {e}", file=sys.stderr)
        return 2
    print(f"status: {report['status']}")
    print(f"hard errors: {report['hard_errors']['total']}")
    print(f"warnings: {report['warnings']['total']}")
    print(f"diagnostics: {report['diagnostics']['total']}")
    print(f"report: {a.report}")
    if report["hard_errors"]["total"]:
        return 1
    return 3 if a.fail_on_warnings and report["warnings"]["total"] else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
