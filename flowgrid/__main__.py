"""python -m flowgrid STAGE ...: the stages from the command line."""

from __future__ import annotations

import argparse
import json

from flowgrid.plans import stages
from flowgrid.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowgrid")
    sub = p.add_subparsers(dest="stage", required=True)

    def add(name: str, run, *paths: str, **options) -> None:
        one = sub.add_parser(name)
        for path in paths:
            one.add_argument(f"--{path}", required=True)
        for option, default in options.items():
            kind = type(default) if default is not None else int
            if kind is bool:
                one.add_argument(f"--{option.replace('_', '-')}", action="store_true")
            elif kind is tuple:
                one.add_argument(f"--{option}", nargs="*", default=[])
            else:
                one.add_argument(f"--{option.replace('_', '-')}", type=kind, default=default)
        one.set_defaults(run=run)

    add("audit", stages.audit, "folder", "out", recursive=False, limit=None)
    add("external-audit", stages.external_audit, "folder", "out", label="", threshold=0.999)
    add("pilot", stages.pilot_stage, "audited", "folder", "out", most=200_000)
    add("label", stages.label_stage, "pilot", "extra", "out", rows=10_000, wanted="Mirai")
    add("prepare", stages.prepare_stage, "path", "out")
    add("sort", stages.sort_stage, "folder", "out")
    add("encode", stages.encode_stage, "folder", "out")
    add("split", stages.split_stage, "folder", "out", seed=42, fold=0)
    add("validate", stages.validate_stage, "folder", "split_folder", "out", seed=42, fold=0)
    add("select", stages.select_stage, "folder", "out", without=(), keep=15, trees=100, depth=12, shap_per_class=500)
    add("correlate", stages.correlate_stage, "folder", "ranking", "out", variance_threshold=1e-8, redundancy_threshold=0.999)
    add("represent-audit", stages.represent_audit_stage, "images", "out", feature="uid")
    add("index", stages.index_stage, "images", "split_folder", "out")
    add("lookup", stages.lookup_stage, "index", "out")
    add("hash-split", stages.hash_split_stage, "index", "out")
    add("diagnose", stages.diagnose_stage, "predictions", "index", "out")
    add("train", stages.train_stage, "index", "images", "out", epochs=20, steps=10, patience=5, hidden=16, seed=42, batch=8)
    add("evaluate", stages.evaluate_stage, "index", "images", "model", "out", confirm=False)
    return p


def main(arguments: list[str] | None = None) -> dict:
    given = vars(parser().parse_args(arguments))
    given.pop("stage")
    run = given.pop("run")
    done = run(build_session("flowgrid"), **{k: (v or None) if k == "label" else v for k, v in given.items()})
    print(json.dumps(done))
    return done


if __name__ == "__main__":
    main()
