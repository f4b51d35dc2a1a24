"""python -m lectern convert | paragraphs | deck | download: one document to a workbook."""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from .operators import enrich as E
from .operators import providers
from .plans import run as R
from .plans.convert import QualityGateError
from .sources import documents as D

FLAGS = {  # option -> what it sets
    "--include-front-matter": ("include_front_matter", True), "--include-appendix": ("include_appendix", True), "--no-include-appendix": ("include_appendix", False), "--skip-references": ("skip_references", True),
    "--insecure": ("insecure", True), "--include-toc": ("include_toc", True), "--no-skip-cover": ("skip_cover", False), "--show-issues": ("show_issues", True), "--force-export": ("force_export", True),
    "--export-low-confidence": ("export_low_confidence", True), "--include-references": ("include_references", True),
}
CHOICES = {"--mode": ("mode", R.MODES), "--profile": ("profile", R.PROFILES), "--heading-style": ("heading_style", ("auto", "numbered", "legal")), "--format": ("fmt", ("default", "standard")), "--render": ("render", ("auto", "always", "never")), "--ocr-mode": ("ocr_mode", ("off", "detect"))}
VALUES = ("standard_id", "standard_title", "standard_edition", "document_id", "document_name", "document_revision", "ca_bundle", "review_output", "parser", "cache")
NUMBERS = ("gap_factor", "min_confidence")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description="Documents to workbooks.")
    subs = top.add_subparsers(dest="command", required=True)
    usual = {f.name: f.default for f in dataclasses.fields(R.Options)}
    for name, said in (("convert", "find out what a file or address is and convert it"), ("paragraphs", "running text to paragraphs"), ("deck", "slides and their tables"), ("download", "fetch a PDF from an address and convert it")):
        p = subs.add_parser(name, help=said)
        p.add_argument("source")
        p.add_argument("-o", "--output")
        if name == "download":
            p.add_argument("--folder", default=".")
        for option, (to, known) in CHOICES.items():
            p.add_argument(option, dest=to, choices=known, default=usual[to])
        for option, (to, value) in FLAGS.items():
            p.add_argument(option, dest=to, action="store_const", const=value, default=usual[to])
        for to in VALUES:
            p.add_argument(f"--{to.replace('_', '-')}", dest=to, default=usual[to])
        for to in NUMBERS:
            p.add_argument(f"--{to.replace('_', '-')}", dest=to, type=float, default=usual[to])
        p.add_argument("--ai-fill", action="store_true", help="ask a provider about each clause; needs --format standard")
        p.add_argument("--ai-provider", choices=providers.provider_names(), default="offline")
        p.add_argument("--ai-model", default="")
        p.add_argument("--ai-batch-size", type=int, default=12)
        p.add_argument("--ai-workers", type=int, default=4)
        p.add_argument("--ai-temperature", type=float, default=0.0)
        p.add_argument("--ai-dry-run", action="store_true")
    return top


def _provider(args: argparse.Namespace, cfg: E.Config) -> E.Provider:
    kind = E.PROVIDERS[args.ai_provider]
    return kind(model=args.ai_model, temperature=args.ai_temperature, schema=E.schema(cfg)) if issubclass(kind, providers.HttpProvider) else kind()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    options = {f.name: getattr(args, f.name) for f in dataclasses.fields(R.Options) if hasattr(args, f.name)}
    if args.command in ("paragraphs", "deck"):
        options["mode"] = {"paragraphs": "prose", "deck": "tables"}[args.command]
    source = args.source
    if args.command == "download":
        source = D.download(source, args.folder, insecure=args.insecure, ca_bundle=args.ca_bundle)
    name = os.path.splitext(os.path.basename(urlparse(source).path if "://" in source else source))[0]
    output = args.output or f"{name or 'output'}.xlsx"
    cfg = provider = None
    if args.ai_fill and args.fmt != "standard":
        print("--ai-fill needs --format standard and is left out", file=sys.stderr)
    elif args.ai_fill:
        cfg = E.Config(provider=args.ai_provider, model=args.ai_model, batch_size=args.ai_batch_size, workers=args.ai_workers, dry_run=args.ai_dry_run)
        provider = None if args.ai_dry_run else _provider(args, cfg)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    try:
        found = R.convert(spark, source, output, cfg, lambda done, total, what: print(f"{what}: {done} of {total}", file=sys.stderr), provider, **options)
    except QualityGateError as e:
        print("\n".join(["quality checks failed:", *[f"  {f[2]}" for f in e.failures[:8]]]), file=sys.stderr)
        return 2
    except (E.ProviderError, D.AccessError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{found.mode}: {found.summary['n_items']} items ({found.summary['n_requirements']} requirements, {found.summary['n_information']} information) -> {output}")
    for w in found.warnings[:8]:
        print(f"warning: {w}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
