"""URL rules by a sorted digest array.

A rule is a host, a path and an action; it fits the host and all its subdomains where the URL's path starts with
the rule's. Spark sorts the rules by the XXH64 of their text and writes them as shards of fixed layout into the
shared folder: sorted digests, offsets, texts, actions. Spark's file distribution gives each machine one copy, and
every worker there maps it into memory, so a machine holds a list once and only the pages that are touched. URLs
are probed in batches: the texts a URL could match are digested, looked up by one vectorised binary search, and a
rule counts only where the stored text is equal byte by byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.text import map_batches, raw_texts, slices
from casekit.sources.files import stage, staging_path

SEED = 42
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACTIONS = ("allow", "block")
MAPPED_BYTES = 64 << 30
SHARD_RULES = 4_000_000


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substr(text, at + 3)).otherwise("")


@dataclass(frozen=True)
class DigestArray:
    """Names of the distributed shards, and what bounds the texts to probe."""

    shards: tuple[str, ...]
    path_lengths: tuple[int, ...]
    longest_host: int
    n_rules: int


def _layout(digests: np.ndarray, texts: list[bytes], actions: list[int]) -> bytes:
    """A shard: count; digests; ends of the texts; actions, padded to eight bytes; the texts themselves."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    flags = np.array(actions, np.uint8).tobytes()
    head = np.array([len(texts)], np.int64).tobytes() + digests.tobytes() + ends.tobytes()
    return head + flags + bytes(-len(flags) % 8) + b"".join(texts)


class Shard:
    """One mapped shard."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view(np.int64)[0])
        self.digests = data[8 : 8 + 8 * n].view(np.uint64)
        self.ends = data[8 + 8 * n : 8 + 16 * n].view(np.int64)
        self.actions = data[8 + 16 * n : 8 + 17 * n]
        self.texts = data[8 + 16 * n + n + (-n % 8) :]

    def text(self, k: int) -> bytes:
        return self.texts[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes()

    def find(self, digests: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(place, action) of the probes whose text is stored here; equal digests are all compared."""
        first = np.searchsorted(self.digests, digests, "left")
        last = np.searchsorted(self.digests, digests, "right")
        for i in np.flatnonzero(first < last).tolist():
            for k in range(int(first[i]), int(last[i])):
                if self.text(k) == texts[i]:
                    yield i, int(self.actions[k])


def _rules(rules: DataFrame) -> DataFrame:
    """(rule, host, path, blocks): one row per distinct rule; a rule both allowed and blocked blocks."""
    known = rules.where(F.col("host").isNotNull() & F.col("action").isin(*ACTIONS)).select(
        F.translate("host", CAPITALS, CAPITALS.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        (F.col("action") == "block").cast("int").alias("blocks"),
    )
    merged = known.groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    return merged.select(F.concat("host", "path").alias("rule"), "host", "path", "blocks")


def digest_array(rules: DataFrame, most_bytes: int = MAPPED_BYTES, shard_rules: int = SHARD_RULES) -> DigestArray | None:
    """The array of rules with columns host, path and action (`allow` or `block`), given to every machine.

    Null paths are empty; rules without host or with another action are passed over. A host has no `/`, `?` or
    `#`, and a path is empty or begins with `/`. None if the shards together pass `most_bytes` on a machine's disk:
    `url_verdicts` then joins. Sorting, digests and shards are Spark's work; the driver sees the shards' names.
    """
    spark = rules.sparkSession
    table = stage(_rules(rules), "rules")
    size = table.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("rule") + 17), F.lit(0)),
        F.coalesce(F.max(F.octet_length("host")), F.lit(0)), F.collect_set(F.octet_length("path")),
    ).first()
    if size[1] > most_bytes:
        return None
    folder = f"{staging_path(spark, 'digests')}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    home.getFileSystem(conf).mkdirs(home)
    target = home.getFileSystem(conf).makeQualified(home).toString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            whole = pa.Table.from_batches(parts)
            texts = [t.encode() for t in whole.column("rule").to_pylist()]
            digests = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64)
            order = np.lexsort((np.arange(len(texts)), digests))
            actions = whole.column("blocks").to_pylist()
            name = f"{uuid.uuid4().hex}.digests"  # a second attempt of a task writes a second file; only one is returned
            store, at = pyarrow.fs.FileSystem.from_uri(target)
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(_layout(digests[order], [texts[k] for k in order], [actions[k] for k in order]))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    n = max(1, -(-size[0] // shard_rules))
    dealt = table.repartitionByRange(n, F.xxhash64("rule")).select("rule", "blocks")
    names = sorted(r["name"] for r in map_batches(dealt, written, "name string").collect())
    for name in names:
        spark.sparkContext.addFile(f"{target}/{name}")
    return DigestArray(tuple(names), tuple(sorted(size[3])), size[2], size[0])


def _suffixes(host: bytes, longest: int) -> list[bytes]:
    """The host and its parents, longest first, as far as the longest host of a rule."""
    out, at = [], 0
    while True:
        if len(host) - at <= longest:
            out.append(host[at:])
        at = host.find(b".", at) + 1
        if not at:
            return out


def _best(hosts: list[bytes], paths: list[bytes], array: DigestArray, shards: list[Shard]) -> list[tuple[bytes, int] | None]:
    """The longest rule of each URL; of equally long ones that with the longer host."""
    texts, owners, ranks = [], [], []
    parents = {h: _suffixes(h, array.longest_host) for h in set(hosts)}
    for i, (host, path) in enumerate(zip(hosts, paths)):
        cuts = [path[:n] for n in array.path_lengths if n <= len(path)]
        for parent in parents[host]:
            texts += [parent + cut for cut in cuts]
            owners += [i] * len(cuts)
            ranks += [len(parent)] * len(cuts)
    best: list[tuple | None] = [None] * len(hosts)
    own = list(set(texts))
    digests = np.array([xxhash.xxh64_intdigest(t, SEED) for t in own], np.uint64)
    found = {own[i]: action for shard in shards for i, action in shard.find(digests, own)}
    if found:
        for text, i, rank in zip(texts, owners, ranks):
            if text in found and (best[i] is None or (len(text), rank) > (len(best[i][0]), best[i][2])):
                best[i] = (text, found[text], rank)
    return best


def _probed(urls: DataFrame, array: DigestArray) -> DataFrame:
    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Shard(SparkFiles.get(name)) for name in array.shards]
        for batch in slices(batches, "path"):
            best = _best(raw_texts(batch, "host"), raw_texts(batch, "path"), array, shards)
            rules = pa.array([b and b[0].decode() for b in best], pa.string())
            verdicts = pa.array([b and ACTIONS[b[1]] for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rules, verdicts], [*batch.schema.names, "rule", "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return map_batches(urls, probed, f"{schema}, rule string, verdict string")


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join, for lists that are too large for a machine: URLs meet the rules of their parent hosts.

    A (host, path prefix) is looked up by its text; the lengths of paths and hosts that occur in rules bound the
    prefixes. Equal URLs are looked up once.
    """
    table = stage(_rules(rules), "rules")
    longest, lengths = table.agg(
        F.coalesce(F.max(F.char_length("host")), F.lit(0)), F.array_sort(F.collect_set(F.char_length("path")))
    ).first()
    # The last labels that a rule's host could have; a first label that the cut has halved does not count.
    labels = F.split(F.expr(f"right(host, {longest + 1})"), r"\.")
    labels = F.when(F.char_length("host") > longest, F.slice(labels, 2, F.size(labels))).otherwise(labels)
    parents = F.transform(
        F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")
    )
    urls = stage(urls, "urls")
    texts = urls.select("host", "path").distinct().select("host", "path", labels.alias("labels")).where(F.size("labels") > 0)
    tried = texts.select("host", "path", F.explode(parents).alias("parent")).select(
        "host", "path", "parent",
        F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("path"))).alias("n"),
    )
    tried = tried.select("host", "path", "parent", F.concat("parent", F.substring("path", F.lit(1), F.col("n"))).alias("rule"))
    met = tried.join(table.select("rule", F.col("host").alias("parent"), "blocks"), ["rule", "parent"])
    best = met.groupBy("host", "path").agg(
        F.max(F.struct(F.octet_length("rule"), F.octet_length("parent"), "rule", "blocks")).alias("best")
    )
    out = urls.join(best, ["host", "path"], "left")
    verdict = F.when(F.col("best.blocks") == 1, "block").when(F.col("best.blocks") == 0, "allow")
    return out.select(*urls.columns, F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def url_verdicts(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow",
    most_bytes: int = MAPPED_BYTES,
) -> DataFrame:
    """id, host, path, the longest rule that fits (else null) and the verdict: the rule's action, else `default`.

    One row per row of the pages; repeated rows stay repeated, null ids are kept. Null URLs and those without `://`
    have an empty host and path, which only a rule of that text could fit. An empty host of a rule fits hosts that
    end in a dot. With no rules every URL has the default. Only the two named columns are read, so other columns may
    have any name. Of two rules equally long the one with the longer host wins. URLs are taken whole, however long.
    """
    own = pages.select(
        F.col(id_column).alias("page_id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    )
    array = digest_array(rules, most_bytes)
    found = _joined(own, rules) if array is None else _probed(own, array)
    return found.withColumnsRenamed({"page_id": id_column}).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
