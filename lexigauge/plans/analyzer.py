"""All metrics of a corpus and its tokenizers, assembled into one nested result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measure import Measure
from ..operators import metrics as M
from ..operators import morphology
from ..operators.encode import Tokenizer, encode, spelled, spelled_counts, tokenizers_table, vocabulary
from ..operators.facts import Facts, doc_facts, token_counts, with_groups
from ..operators.validate import Watch, estimated_vocabulary

GROUP = ("group_type", "group_name")


def _stats(r: Any) -> dict[str, float]:
    return {s: r[s] for s in M.STATS}


#: A further metric: a frame of facts and key columns, with the tokenizer among its columns.
Metric = Callable[[Facts, Sequence[str]], DataFrame]
METRICS: dict[str, Metric] = {}


def register_metric(name: str, f: Metric) -> None:
    """Every analyzer made from now on has this metric, by tokenizer and by group."""
    if not callable(f):
        raise TypeError("a metric is registered by a function of facts and keys")
    METRICS[name] = f


class Analyzer:
    """Tokens and facts of a corpus; results() runs the metrics.

    Facts are kept while the analyzer is in use, since every metric reads them; close()
    lets them go. Both are far smaller than the corpus.
    """

    def __init__(self, tokens: DataFrame, tokenizers: DataFrame | None = None, *, measure: Measure = Measure(), lexicon: DataFrame | None = None, groups: DataFrame | None = None, strict: bool = False, known: Sequence[Tokenizer] = (), plugins: dict[str, Metric] | None = None):
        watch = Watch(tokens, tokenizers) if strict else None
        self.tokens = tokens
        self.lexicon, self.groups, self.known = lexicon, groups, list(known)
        self.plugins = METRICS | (plugins or {})
        self._aligned: DataFrame | None = None
        sizes = tokenizers if tokenizers is not None else estimated_vocabulary(tokens)
        keep = StorageLevel.MEMORY_AND_DISK
        docs = doc_facts(watch.frame if watch else tokens, measure).persist(keep)
        if watch:
            # rules are counted by the pass that fills the cache
            docs.count()
            watch.check()
        self.facts = Facts(docs, token_counts(tokens).persist(keep), sizes, measure, True)

    @classmethod
    def of_corpus(cls, corpus: DataFrame, tokenizers: list[Tokenizer], **kw: Any) -> Analyzer:
        """corpus: doc_id, language, text."""
        return cls(encode(corpus, tokenizers, strict=kw.get("strict", False)), tokenizers_table(corpus.sparkSession, tokenizers), known=tokenizers, **kw)

    @classmethod
    def of_tokens(cls, tokens: DataFrame, vocab_sizes: dict[str, int] | None = None, **kw: Any) -> Analyzer:
        """tokens: tokenizer, language, doc_id, text, tokens."""
        sizes = tokens.sparkSession.createDataFrame([(t, n, None) for t, n in vocab_sizes.items()], "tokenizer string, vocab_size long, unk_id int") if vocab_sizes else None
        return cls(tokens, sizes, **kw)

    @classmethod
    def mixed(cls, corpus: DataFrame, tokenizers: list[Tokenizer], tokens: DataFrame, **kw: Any) -> Analyzer:
        """Encoded texts beside tokens that were given; names must not meet."""
        spark = corpus.sparkSession
        if both := name_conflicts(tokenizers, tokens):
            raise ValueError(f"tokenizers given twice: {both}")
        made = encode(corpus, tokenizers)
        sizes = tokenizers_table(spark, tokenizers).unionByName(estimated_vocabulary(tokens).withColumn("unk_id", F.lit(None).cast("int")))
        return cls(made.unionByName(tokens.select(made.columns)), sizes, known=tokenizers, **kw)

    def close(self) -> None:
        self.facts.docs.unpersist()
        self.facts.counts.unpersist()
        if self._aligned is not None:
            self._aligned.unpersist()

    def register_views(self, prefix: str = "") -> list[str]:
        """Facts and metrics as temporary views, for Spark SQL; their names."""
        views = {"doc_facts": self.facts.docs, "token_counts": self.facts.counts, **self.frames()}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in views]

    def frames(self, keys: Sequence[str] = ("tokenizer",), facts: Facts | None = None) -> dict[str, DataFrame]:
        """The metrics' frames by name."""
        f = facts or self.facts
        return {
            "fertility": M.fertility(f, keys),
            "token_length": M.token_length(f, keys),
            "vocabulary_utilization": M.vocabulary_utilization(f, keys),
            "type_token_ratio": M.type_token_ratio(f, keys),
            "avg_tokens_per_line": M.tokens_per_line(f, keys),
            "compression_ratio": M.compression(f, keys),
            "renyi_efficiency": M.renyi(f, keys=keys),
            "unigram_distribution_metrics": M.unigram(f, keys),
            "tokenizer_fairness_gini": M.gini(f, keys),
            "language_costs": M.language_costs(f, keys),
            "lorenz_curve_data": M.lorenz(f, keys),
            **self._unknown(keys, f),
            **{n: g(f, keys) for n, g in self.plugins.items()},
        }

    def _unknown(self, keys: Sequence[str], f: Facts) -> dict[str, DataFrame]:
        """Per cent of unknown tokens, if any tokenizer has an unknown one."""
        if f.tokenizers is None or "unk_id" not in f.tokenizers.columns:
            return {}
        groups = [k for k in keys if k != "tokenizer"]
        tokens = with_groups(self.tokens, self.groups) if groups else self.tokens
        return {"unknown_share": M.unknown_share(tokens, f.tokenizers, keys)}

    def spelled_counts(self) -> DataFrame:
        """Token counts with the tokens' strings and ids, of tokenizers that have a vocabulary."""
        return spelled_counts(self.facts.counts, vocabulary(self.facts.counts.sparkSession, self.known))

    def results(self, only: Sequence[str] | None = None) -> dict[str, Any]:
        """Nested results; with a lexicon also morphology, with groups also grouped_analysis. only: tokenizers to compare."""
        rows = {n: d.collect() for n, d in self.frames().items()}
        out = nested(rows, self.facts.measure, only)
        if self.lexicon is not None:
            out |= self.morphology(only)
        if self.groups is not None:
            f = self.facts
            grouped = Facts(with_groups(f.docs, self.groups), with_groups(f.counts, self.groups), f.tokenizers, f.measure, True)
            got: dict[tuple[str, str], dict[str, list]] = {}
            for n, d in self.frames(("tokenizer", *GROUP), grouped).items():
                for r in d.collect():
                    got.setdefault((r["group_type"], r["group_name"]), {}).setdefault(n, []).append(r)
            out["grouped_analysis"] = {}
            for (kind, name), x in sorted(got.items()):
                out["grouped_analysis"].setdefault(kind, {})[name] = nested(x, f.measure, only)
            if self.lexicon is not None:
                groups: dict[tuple[str, str], dict[str, list]] = {}
                for n, d in self.morphology_frames(("tokenizer", *GROUP)).items():
                    for r in d.collect():
                        groups.setdefault((r["group_type"], r["group_name"]), {}).setdefault(n, []).append(r)
                for (kind, name), x in groups.items():
                    out["grouped_analysis"].setdefault(kind, {}).setdefault(name, {}).update(nested_morphology(x, only))
        return out

    def aligned(self) -> DataFrame:
        """Scores of distinct words, kept while the analyzer is in use: a row for each tokenizer, language, word and its tokens."""
        if self._aligned is None:
            self._aligned = morphology.alignment(spelled(self.tokens, self.known), self.lexicon).persist(StorageLevel.MEMORY_AND_DISK)
        return self._aligned

    def morphology_frames(self, keys: Sequence[str] = ("tokenizer",)) -> dict[str, DataFrame]:
        """Scores by language and their summaries, of alignment and MorphScore; with the columns of groups also by group.

        Words are scored once; groups only join the rows of languages.
        """
        scored = self.aligned()
        langs, scores = morphology.by_language(scored), morphology.morph_scores(scored)
        if len(keys) > 1:
            langs, scores = with_groups(langs, self.groups), with_groups(scores, self.groups)
        return {"alignment": langs, "alignment_summary": morphology.summary(langs, keys), "morphscore": scores, "morphscore_summary": morphology.morph_summary(scores, keys)}

    def morphology(self, only: Sequence[str] | None = None) -> dict[str, Any]:
        """Morphological alignment and MorphScore of all languages."""
        return nested_morphology({n: d.collect() for n, d in self.morphology_frames().items()}, only)


def nested_morphology(rows: dict[str, list], only: Sequence[str] | None = None) -> dict[str, Any]:
    """Rows of the morphology frames as the nested result."""
    r = {n: [x.asDict() for x in v if only is None or x["tokenizer"] in only] for n, v in rows.items()}
    rest = lambda x: {k: v for k, v in x.items() if k not in ("tokenizer", *GROUP)}
    per: dict[str, Any] = {}
    for x in r.get("alignment", []):
        per.setdefault(x["tokenizer"], {}).setdefault(x["metric"], {})[_lang(x)] = {k: x[k] for k in ("count", "mean", "std")}
    scores: dict[str, Any] = {}
    for x in r.get("morphscore", []):
        scores.setdefault(x["tokenizer"], {"per_language": {}})["per_language"][_lang(x)] = {k: x[k] for k in (*morphology.MORPH_SCORES, "num_samples")}
    for x in r.get("morphscore_summary", []):
        scores[x["tokenizer"]]["summary"] = rest(x)
    return {"morphological_alignment": {"per_tokenizer": per, "summary": {x["tokenizer"]: rest(x) for x in r.get("alignment_summary", [])}}, "morphscore": {"per_tokenizer": scores}}


def name_conflicts(tokenizers: list[Tokenizer], tokens: DataFrame) -> list[str]:
    """Names of tokenizers that tokens have already. A table has few tokenizers."""
    return sorted({t.name for t in tokenizers} & {r[0] for r in tokens.select("tokenizer").distinct().collect()})


def compared(values: dict[str, float | None]) -> dict[str, dict[str, Any]]:
    """Each two tokenizers' values."""
    out = {}
    names = [n for n, v in values.items() if v is not None]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = values[a], values[b]
            out[f"{a}_vs_{b}"] = {"tokenizer_1": a, "tokenizer_2": b, "value_1": x, "value_2": y, "difference": x - y, "ratio": x / y if y else 1.0, "percent_difference": abs(x - y) / ((x + y) / 2) * 100 if x + y else 0.0}
    return out


def _lang(r: Any) -> str:
    """A language's name in nested results; texts without one are those of "null"."""
    return "null" if r["language"] is None else r["language"]


def nested(rows: dict[str, list], measure: Measure, only: Sequence[str] | None = None) -> dict[str, Any]:
    """Rows of the metrics' frames as the nested result."""
    r = {n: [x for x in v if only is None or x["tokenizer"] in only] for n, v in rows.items()}
    names = sorted({x["tokenizer"] for v in r.values() for x in v})
    out: dict[str, Any] = {n: {"per_tokenizer": {t: {} for t in names}} for n in ("fertility", "token_length", "vocabulary_utilization", "type_token_ratio", "avg_tokens_per_line", "compression_ratio", "renyi_efficiency", "unigram_distribution_metrics", "tokenizer_fairness_gini", "lorenz_curve_data")}
    per = lambda n, t: out[n]["per_tokenizer"][t]
    for x in r.get("fertility", []):
        if x["pooled"]:
            per("fertility", x["tokenizer"])["global"] = _stats(x)
        else:
            per("fertility", x["tokenizer"]).setdefault("per_language", {})[_lang(x)] = _stats(x)
    out["fertility"] |= {"per_language": {}, "metadata": {"normalization_method": measure.method, "description": f"tokens per {measure.unit}", "short_description": f"tokens/{measure.unit}"}}
    for x in r.get("token_length", []):
        per("token_length", x["tokenizer"]).update(character_length=_stats(x), primary_length=_stats(x))
    out["token_length"]["metadata"] = {"primary_unit": "characters", "description": "characters per token"}
    for x in r.get("vocabulary_utilization", []):
        if x["pooled"]:
            per("vocabulary_utilization", x["tokenizer"]).update(global_utilization=x["utilization"], global_used_tokens=x["used_tokens"], global_vocab_size=x["vocab_size"])
        else:
            per("vocabulary_utilization", x["tokenizer"]).setdefault("per_language", {})[_lang(x)] = {k: x[k] for k in ("utilization", "used_tokens", "vocab_size", "unused_tokens")}
    for x in r.get("type_token_ratio", []):
        if x["pooled"]:
            per("type_token_ratio", x["tokenizer"]).update(global_ttr=x["ttr"], global_types=x["types"], global_tokens=x["tokens"])
        else:
            out["type_token_ratio"].setdefault("per_language", {}).setdefault(_lang(x), {})[x["tokenizer"]] = x["ttr"]
    for x in r.get("avg_tokens_per_line", []):
        per("avg_tokens_per_line", x["tokenizer"]).update(global_avg=x["mean"], global_std=x["std"], global_std_err=x["std_err"], total_lines=x["total_lines"], stats=_stats(x))
    for x in r.get("compression_ratio", []):
        if x["pooled"]:
            per("compression_ratio", x["tokenizer"]).update({"global": _stats(x), "num_texts_analyzed": x["count"]})
        else:
            per("compression_ratio", x["tokenizer"]).setdefault("per_language", {})[_lang(x)] = x["mean"]
    out["compression_ratio"]["metadata"] = {"normalization_method": measure.method}
    for x in r.get("renyi_efficiency", []):
        key, lang = f"renyi_{x['alpha']}", "overall" if x["pooled"] else _lang(x)
        per("renyi_efficiency", x["tokenizer"]).setdefault(key, {})[lang] = x["entropy"]
        if not x["pooled"]:
            out["renyi_efficiency"].setdefault("per_language", {}).setdefault(key, {}).setdefault(lang, {})[x["tokenizer"]] = x["entropy"]
    for x in r.get("unigram_distribution_metrics", []):
        p = per("unigram_distribution_metrics", x["tokenizer"])
        if x["pooled"]:
            p.update(global_unigram_entropy=x["unigram_entropy"], global_avg_token_rank=x["avg_token_rank"])
            continue
        p.setdefault("per_language", {})[_lang(x)] = {k: x[k] for k in ("unigram_entropy", "avg_token_rank", "total_tokens", "unique_tokens")}
        for k in ("unigram_entropy", "avg_token_rank"):
            out["unigram_distribution_metrics"].setdefault("per_language", {}).setdefault(k, {}).setdefault(_lang(x), {})[x["tokenizer"]] = x[k]
    costs: dict[str, list] = {}
    for x in sorted(r.get("language_costs", []), key=lambda x: (x["cost"], _lang(x))):
        costs.setdefault(x["tokenizer"], []).append((_lang(x), x["cost"]))
    for x in r.get("tokenizer_fairness_gini", []):
        c = costs.get(x["tokenizer"], [])
        if len(c) < 2:
            per("tokenizer_fairness_gini", x["tokenizer"]).update(gini_coefficient=0.0, mean_cost=0.0, language_costs=dict(c), warning="fewer than two languages")
        else:
            per("tokenizer_fairness_gini", x["tokenizer"]).update({k: x[k] for k in ("gini_coefficient", "mean_cost", "std_cost", "min_cost", "max_cost", "cost_ratio", "most_efficient_language", "least_efficient_language", "num_languages")} | {"language_costs": dict(c), "sorted_language_costs": c})
    points: dict[str, list] = {}
    for x in r.get("lorenz_curve_data", []):
        points.setdefault(x["tokenizer"], []).append(x)
    for t in names:
        p = sorted(points.get(t, []), key=lambda x: x["i"])
        if not p:
            per("lorenz_curve_data", t)["warning"] = "fewer than two languages"
            continue
        c = costs[t]
        per("lorenz_curve_data", t).update(x_values=[x["x"] for x in p], y_values=[x["y"] for x in p], equality_line=[x["x"] for x in p], sorted_languages=[x[0] for x in c], sorted_costs=[x[1] for x in c], total_cost=sum(x[1] for x in c), n_languages=len(c))
    for x in r.get("unknown_share", []):
        p = out.setdefault("unknown_share", {"per_tokenizer": {t: {} for t in names}})["per_tokenizer"][x["tokenizer"]]
        if x["pooled"]:
            p["global"] = _stats(x)
        else:
            p.setdefault("per_language", {})[_lang(x)] = _stats(x)
    for n in set(r) - KNOWN:
        out[n] = {"per_tokenizer": {t: [{k: v for k, v in x.asDict().items() if k not in ("tokenizer", *GROUP)} for x in r[n] if x["tokenizer"] == t] for t in names}}
    if len(names) > 1:
        pick = lambda n, *path: {t: _deep(out[n]["per_tokenizer"][t], path) for t in names}
        out["fertility"]["pairwise_comparisons"] = compared(pick("fertility", "global", "mean"))
        out["compression_ratio"]["pairwise_comparisons"] = compared(pick("compression_ratio", "global", "mean"))
        out["renyi_efficiency"]["pairwise_comparisons"] = {"shannon": compared(pick("renyi_efficiency", "renyi_1.0", "overall"))}
        out["unigram_distribution_metrics"]["pairwise_comparisons"] = {k: compared(pick("unigram_distribution_metrics", k)) for k in ("global_unigram_entropy", "global_avg_token_rank")}
    return out


#: Frames that nested() gives a form of their own; those of further metrics stay rows.
KNOWN = {"fertility", "token_length", "vocabulary_utilization", "type_token_ratio", "avg_tokens_per_line", "compression_ratio", "renyi_efficiency", "unigram_distribution_metrics", "tokenizer_fairness_gini", "language_costs", "lorenz_curve_data", "unknown_share"}


def _deep(x: Any, path: Sequence[str]) -> Any:
    for k in path:
        x = x.get(k) if isinstance(x, dict) else None
    return x
