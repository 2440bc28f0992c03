"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown on statistics of a bounded sample of labelled texts. Every path from a root becomes a
rule, a conjunction of comparisons; a logistic regression with a lasso penalty gives most rules the weight 0.
The rest is compiled to one Spark expression over the statistics, which are Spark expressions over the text. So
scoring is a scan without Python, shuffles or models to load.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.labelled import SAMPLE_ROWS, labelled_sample
from casekit.sources.files import stage

THRESHOLD = 0.3
TREES = 16
DEPTH = 3
PENALTY = 0.001
BRANCH = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)")

Condition = tuple[str, str, float]


@dataclass(frozen=True)
class RuleModel:
    """A rule counts with its weight if all its conditions on the statistics hold."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, statistics: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[Condition, ...], statistics: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, sign, limit in rule:
        out = out & (statistics[name] <= limit if sign == "<=" else statistics[name] > limit)
    return out


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; all are 0 for one without words. Rates are per word."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    lines = F.split(text, "\n")
    count = F.size(words)

    def rate(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) / count

    return {
        "log_words": F.log1p(count.cast("double")),
        "word_chars": F.char_length(text) / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_a_line": count / F.size(lines),
        "symbols": rate(r"[#*$%&|<>]++"),
        "bars": rate(r"(?<=\s)[|](?=\s)"),
        "shouts": rate("!!"),
        "capitals": rate(r"\p{Lu}{2,}+"),
        "echoes": rate(r"(?<!\S)(\S++)(?=\s++\1(?!\S))"),
        "sentences": rate(r"[.!?](?=\s|$)"),
        "digits": rate(r"[0-9]++"),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one column `stat_<name>` for each statistic."""
    return docs.withColumns({f"stat_{k}": F.coalesce(v, F.lit(0.0)) for k, v in statistics(F.col(text)).items()})


def tree_rules(debug_text: str, names: list[str]) -> list[tuple[Condition, ...]]:
    """Every path from a root to an inner node or leaf of the trees in MLlib's listing, without repeats."""
    rules: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in debug_text.splitlines():
        if m := BRANCH.match(line):
            indent = len(m[1])
            path = [p for p in path if p[0] < indent]
            path.append((indent, (names[int(m[2])], m[3], float(m[4]))))
            rules[tuple(sorted({c for _, c in path}))] = None
        elif "Tree" in line:
            path = []
    return list(rules)


def fit_rules(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample_rows: int = SAMPLE_ROWS, trees: int = TREES,
    depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7,
) -> RuleModel:
    """Learns from at most `sample_rows` labelled documents. With labels of one kind only, the score is constant."""
    names = list(statistics(F.lit("")))
    known = stage(with_statistics(labelled_sample(docs, labels, label, held_out, sample_rows)).drop("text"), "quality-sample")
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or positive in (0, n):
        return RuleModel(20.0 if n and positive else -20.0 if n else 0.0, ())
    table = VectorAssembler(inputCols=[f"stat_{k}" for k in names], outputCol="features").transform(known)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", subsamplingRate=0.5
    ).fit(table)
    rules = tree_rules(forest.toDebugString, names)
    found = {k: F.col(f"stat_{k}") for k in names}
    flags = known.select("label", F.array(*[_holds(r, found).cast("double") for r in rules]).alias("flags"))
    lasso = LogisticRegression(
        labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False
    )
    fitted = lasso.fit(flags.select("label", array_to_vector("flags").alias("rules")))
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel(float(fitted.intercept), tuple((r, w) for r, w in zip(rules, weights) if w))


def quality_scores(docs: DataFrame, model: RuleModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), one row per document. Null texts count as empty; empty ones get a score too.

    Ids may be null or repeat. Only the named columns are read; whole texts are measured.
    """
    texts = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    found = with_statistics(texts)
    return found.select("doc_id", model.score({k: F.col(f"stat_{k}") for k in statistics(F.lit(""))}).alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns, whatever their names."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    # The row number keeps the filter above the statistics: below, each rule would work them out again.
    packed = docs.select(F.struct("*").alias("row"), text.alias("text"))
    found = with_statistics(packed).withColumn("number", F.monotonically_increasing_id())
    good = model.score({k: F.col(f"stat_{k}") for k in statistics(F.lit(""))}) >= threshold
    return found.where(good & (F.col("number") >= 0)).select("row.*")
