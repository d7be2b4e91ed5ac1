"""Command line: analyse a corpus or tokenized data and write results, tables and plot data."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import functions as F

from .functions.measure import PRESETS, Measure
from .operators.encode import from_config, tokenizer
from .plans import figures, report
from .plans.analyzer import Analyzer
from .session import get_session
from .sources.corpus import LanguageMetadata, read_corpus, read_lexicons, read_tokenized, read_vocabulary
from .sources.sinks import write_cache


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexigauge", description=__doc__)
    src = p.add_argument_group("input")
    src.add_argument("--language-config", help="JSON of languages and groups")
    src.add_argument("--tokenizer-config", help="JSON of tokenizers; two native ones by default")
    src.add_argument("--tokenized-data", help="tokenized records (JSON or Parquet) instead of a corpus")
    src.add_argument("--tokenized-config", help="JSON of vocabulary files of tokenized data")
    src.add_argument("--documents", help="a Parquet table of doc_id, text, lang instead of a language configuration")
    src.add_argument("--samples-per-language", type=int, default=None)
    src.add_argument("--filter-script-family")
    src.add_argument("--filter-resource-level")
    what = p.add_argument_group("analysis")
    what.add_argument("--measurement-config", help="JSON of the unit texts are measured in")
    what.add_argument("--measure", choices=sorted(PRESETS), default="bytes")
    what.add_argument("--morphological-config", help="JSON of lexicons, {name: path}")
    what.add_argument("--run-grouped-analysis", action="store_true")
    what.add_argument("--pairwise", nargs=2, metavar=("A", "B"))
    what.add_argument("--strict", action="store_true")
    out = p.add_argument_group("output")
    out.add_argument("--output-dir", default="results")
    out.add_argument("--save-full-results", action="store_true")
    out.add_argument("--save-tokenized-data", metavar="FOLDER")
    out.add_argument("--no-tables", action="store_true")
    out.add_argument("--custom-tables", help="JSON of further tables")
    out.add_argument("--no-bold", action="store_true")
    out.add_argument("--no-errors", action="store_true")
    out.add_argument("--no-plots", action="store_true")
    out.add_argument("--quiet", action="store_true")
    out.add_argument("--verbose", action="store_true", help="log what is done")
    out.add_argument("--create-sample-configs", metavar="FOLDER", help="write one configuration of each kind and stop")
    return p


def _json(path: str | None):
    if not path:
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


#: A configuration of each kind, to start from.
SAMPLES = {
    "languages.json": {"languages": {"en": {"name": "English", "iso_code": "eng", "data_path": "data/en"}, "de": "data/de.jsonl"}, "analysis_groups": {"script_families": {"latin": ["en", "de"]}}},
    "tokenizers.json": {"words": {"class": "word_punct"}, "bpe": {"class": "huggingface", "path": "tokenizer.json"}, "plot_tokenizers": ["words", "bpe"]},
    "measure.json": {"method": "bytes", "byte_counting": "utf8"},
    "morphology.json": {"ladec": "lexicons/ladec.tsv", "morphynet": "lexicons/morphynet.tsv"},
    "tables.json": {"short": {"metrics": ["fertility", "type_token_ratio"], "caption": "Two metrics", "label": "short"}},
}


def write_samples(folder: str) -> list[str]:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, x in SAMPLES.items():
        Path(folder, name).write_text(json.dumps(x, indent=2), encoding="utf-8")
    return sorted(SAMPLES)


def main(argv: Sequence[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    if a.create_sample_configs:
        return {"written": write_samples(a.create_sample_configs)}
    spark = get_session()
    measure = Measure.from_dict(_json(a.measurement_config)) if a.measurement_config else PRESETS[a.measure]
    meta = LanguageMetadata(a.language_config) if a.language_config else None
    kw = {"measure": measure, "strict": a.strict}
    if a.morphological_config:
        kw["lexicon"] = read_lexicons(spark, _json(a.morphological_config))
    if a.run_grouped_analysis:
        if meta is None:
            raise SystemExit("grouped analysis needs --language-config")
        kw["groups"] = meta.table(spark)
    made: list = []
    if a.tokenized_data:
        vocabs = (_json(a.tokenized_config) or {}).get("vocabulary_files", {})
        an = Analyzer.of_tokens(read_tokenized(spark, a.tokenized_data), {t: len(read_vocabulary(p, t)) for t, p in vocabs.items()} or None, **kw)
        shown = None
    else:
        made, shown = from_config(_json(a.tokenizer_config)) if a.tokenizer_config else ([tokenizer("word_punct"), tokenizer("whitespace")], None)
        if a.documents:
            corpus = spark.read.parquet(a.documents).select("doc_id", F.col("lang").alias("language"), "text")
        elif meta:
            group = ("script_families", a.filter_script_family) if a.filter_script_family else ("resource_levels", a.filter_resource_level) if a.filter_resource_level else None
            corpus = read_corpus(spark, meta, a.samples_per_language, group)
        else:
            raise SystemExit("give --language-config, --documents or --tokenized-data")
        an = Analyzer.of_corpus(corpus, made, **kw)
    results = an.results(a.pairwise)
    names = sorted(results["fertility"]["per_tokenizer"])
    if a.pairwise and (wrong := set(a.pairwise) - set(names)):
        raise SystemExit(f"unknown tokenizers: {sorted(wrong)}")
    shown = [n for n in (shown or names) if n in names]
    report.write_json(results, f"{a.output_dir}/analysis_results.json", small=True)
    if a.save_full_results:
        report.write_json(results, f"{a.output_dir}/analysis_results_full.json")
    if not a.no_tables:
        report.write_tables(results, names, f"{a.output_dir}/latex_tables", _json(a.custom_tables), bold_best=not a.no_bold, errors=not a.no_errors)
    if not a.no_plots:
        figures.draw(report.plot_data(results, shown), shown, f"{a.output_dir}/plots")
    if a.save_tokenized_data:
        write_cache(an.tokens, made, a.save_tokenized_data)
    if not a.quiet:
        print("\n".join(filter(None, [report.summary_text(results, shown), report.morphology_text(results, shown)])))
    logging.getLogger(__name__).info("%s", json.dumps(report.analysis_summary(results, shown)))
    an.close()
    return results


if __name__ == "__main__":
    main()
