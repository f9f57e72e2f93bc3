"""The library's surface for one memory: a folder of tables and the operators over it.

Tables are Parquet in ``root``, which has to be a place that all executors reach. Logs are append-only;
what is current is derived from them. Appends are by key, so that a run that is repeated adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .functions.score import priority
from .operators import claims, distil, lint, retrieval
from .session import moment
from .storage import written

# Names that no namespace may have.
RESERVED = ("snapshots", "candidates", "archive", "default-archive")
LOG = "id string, event_type string, claim_id string, other_id string, fp string, topic_key string, claim_subject string, value string, source_event_id string, ts double, reason string"
OVERRIDES = "ord long, op string, key_type string, key string, actor string"
PREDICATES = "topic_key string, claim_subject string, value_pattern string"
DOCS = "path string, source string, type string, body string, needs_review boolean, mtime double"
POLICY = "ord long, target string, tier string, reviewer string, reason string"


class Memory:
    """A memory below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, rows: DataFrame, key: str) -> int:
        """Adds the rows whose key is new, and returns how many they were."""
        new = rows.dropDuplicates([key]).join(self._table(name, schema).select(key), key, "left_anti")
        new = new.select(*[c.strip().split()[0] for c in schema.split(",")]).cache()
        try:
            n = new.count()
            if n:
                new.write.mode("append").parquet(f"{self.root}/{name}")
            return n
        finally:
            new.unpersist()

    # --- episodes, lessons and policy

    def append_episodic(self, namespace: str, rows: DataFrame) -> None:
        """Adds episodes to a namespace, which is a partition."""
        if namespace in RESERVED or not self.spark.range(1).select(F.lit(namespace).rlike("^[a-z][a-z0-9_-]{0,31}$")).first()[0]:
            raise ValueError(f"{namespace!r} is no namespace")
        rows.withColumn("namespace", F.lit(namespace)).write.mode("append").partitionBy("namespace").parquet(f"{self.root}/episodes")

    def episodes(self, namespace: str | None = None) -> DataFrame:
        """Episodes of one namespace, whose files alone are read, or of all."""
        all_ = self.spark.read.parquet(f"{self.root}/episodes")
        return all_ if namespace is None else all_.where(F.col("namespace") == namespace)

    def stats(self) -> DataFrame:
        """Episodes and failures of each namespace and in total."""
        out = self.episodes().rollup("namespace").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("result") == "failure").alias("failures"))
        return out.withColumn("namespace", F.coalesce("namespace", F.lit("total")))

    def query_semantic(self, lessons: DataFrame, text: str, k: int = 5) -> DataFrame:
        """The newest ``k`` lessons (ord, claim, why, how_to_apply) that hold the text in any part."""
        low = text.lower()
        hit = F.lit(False)
        for part in ("claim", "why", "how_to_apply"):
            hit = hit | F.coalesce(F.lower(part).contains(low), F.lit(False))
        return lessons.where(hit).orderBy(F.desc("ord")).limit(k)

    def write_policy(self, ord_: int, target: str, tier: str, reviewer: str, reason: str) -> None:
        """Adds a decision to the audit log; promotion, demotion and rollback are all decisions."""
        self._append("policy", POLICY, self.spark.createDataFrame([(ord_, target, tier, reviewer, reason)], POLICY), "ord")

    def read_policy(self) -> DataFrame:
        """The last tier of each target."""
        return self._table("policy", POLICY).groupBy("target").agg(F.max_by(F.struct("tier", "reviewer", "reason"), "ord").alias("p")).select("target", "p.*")

    # --- documents

    def reindex(self, docs: DataFrame) -> dict[str, int]:
        """Makes the index hold these documents: what is new or changed is written, what is gone is dropped."""
        old = self._table("docs", DOCS).select("path", F.col("mtime").alias("was"))
        state = docs.select("path", "mtime").join(old, "path", "full_outer").select(F.when(F.col("was").isNull(), "inserted").when(F.col("mtime").isNull(), "pruned").when(F.col("was") != F.col("mtime"), "updated").otherwise("kept").alias("action"))
        counts = {r["action"]: r["count"] for r in state.groupBy("action").count().collect()}
        docs.select(*[c.strip().split()[0] for c in DOCS.split(",")]).write.mode("overwrite").parquet(f"{self.root}/docs.new")
        self.spark.read.schema(DOCS).parquet(f"{self.root}/docs.new").write.mode("overwrite").parquet(f"{self.root}/docs")
        return counts

    def query(self, queries: DataFrame, k: int = 5, source: str | None = None, type: str | None = None, policy: str = "demote", penalty: float = 0.5) -> DataFrame:
        """Ranked documents for queries (qid, query); filters come before ranking, the review policy after it."""
        docs = self._table("docs", DOCS)
        for column, value in (("source", source), ("type", type)):
            docs = docs if value is None else docs.where(F.col(column) == value)
        hits = retrieval.bm25(docs, queries, retrieval.over_fetch(k, policy)).join(docs.select("path", "needs_review"), "path")
        return retrieval.review_policy(hits, policy, penalty).where(F.col("rank") <= k).select("qid", "path", "score", "rank")

    def evaluate(self, queries: DataFrame, support: DataFrame, k: int = 10) -> DataFrame:
        """Recall, reciprocal rank and NDCG of queries against the documents (qid, path) that support them."""
        return retrieval.quality(retrieval.relevance(self.query(queries, k, policy="ignore"), support.select("qid").distinct(), support))

    def lint(self, listing: DataFrame) -> DataFrame:
        """Dead links and paths of the indexed documents, given the files that exist (path)."""
        docs = self._table("docs", DOCS).select(F.col("path").alias("file"), "body")
        names = docs.select(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"))
        return lint.wiki_links(docs, names).union(lint.dead_paths(docs, listing)).orderBy("file", "line", "kind")

    # --- claims

    def consolidate(self, observations: DataFrame) -> dict[str, int]:
        """Adds what a batch of observations says to the claim log: asserts, transitions, retracts. Returns how many of each are new."""
        log = self._table("claims", LOG)
        known = log.where("event_type = 'assert'").select("claim_id")
        asserts = claims.extract(observations).join(known, "claim_id", "left_anti")
        current = self.state().where("stance = 'current'")
        moves = claims.fold(asserts, current)
        everything = claims.extract(observations).unionByName(log.where("event_type = 'assert'").select("claim_id", "fp", "topic_key", "claim_subject", "value", "source_event_id", "ts"))
        gone = claims.tombstones(observations, everything.dropDuplicates(["claim_id"]))
        none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
        rows = {
            "assert": asserts.select(F.col("claim_id").alias("id"), F.lit("assert").alias("event_type"), "claim_id", none.alias("other_id"), "fp", "topic_key", "claim_subject", "value", "source_event_id", "ts", none.alias("reason")),
            "supersede": moves.select(ids.transition_id(F.col("old"), F.col("new"), "supersede", "newer_source_ts").alias("id"), F.lit("supersede").alias("event_type"), F.col("old").alias("claim_id"), F.col("new").alias("other_id"), *[none.alias(c) for c in ("fp", "topic_key", "claim_subject", "value", "source_event_id")], number.alias("ts"), F.lit("newer_source_ts").alias("reason")),
            "retract": gone.select(ids.transition_id(F.col("claim_id"), F.lit(""), "retract", "tombstone_deleted").alias("id"), F.lit("retract").alias("event_type"), "claim_id", none.alias("other_id"), *[none.alias(c) for c in ("fp", "topic_key", "claim_subject", "value", "source_event_id")], number.alias("ts"), "reason"),
        }
        held = {kind: written(r) for kind, r in rows.items()}  # all is derived from the log as it was
        return {kind: self._append("claims", LOG, r, "id") for kind, r in held.items()}

    def override(self, ord_: int, op: str, key_type: str, key: str, actor: str = "") -> None:
        """Adds an operator's retract or restore of a claim or an event."""
        if op not in ("retract", "restore") or key_type not in ("claim_id", "event_id"):
            raise ValueError(f"{op} of a {key_type} is no operation")
        self._append("overrides", OVERRIDES, self.spark.createDataFrame([(ord_, op, key_type, key, actor)], OVERRIDES), "ord")

    def state(self) -> DataFrame:
        """Each claim and its stance, after tombstones and overrides; a restored claim is never retracted."""
        log = self._table("claims", LOG)
        asserts = log.where("event_type = 'assert'").select("claim_id", "fp", "topic_key", "claim_subject", "value", "source_event_id", "ts")
        overrides = self._table("overrides", OVERRIDES)
        restored = claims.resolve_overrides(overrides).where("key_type = 'claim_id' and op = 'restore'").select(F.col("key").alias("claim_id"))
        by_operator = claims.overridden(asserts, overrides, self.spark.createDataFrame([], PREDICATES))
        gone = log.where("event_type = 'retract'").select("claim_id").union(by_operator).join(restored, "claim_id", "left_anti")
        return claims.elect(asserts, gone)

    def trace(self, claim: str) -> DataFrame:
        """All that the log says of a claim."""
        return self._table("claims", LOG).where((F.col("claim_id") == claim) | (F.col("other_id") == claim))

    # --- candidates

    def pending(self, candidates: DataFrame, decisions: DataFrame, k: int = 10, as_of: str | None = None) -> DataFrame:
        """The ``k`` staged candidates (id, cluster_size, canonical_salience, staged_at) of highest priority."""
        staged = distil.decide(candidates, decisions).where("status = 'staged'").select("id")
        now = moment(as_of) if as_of else moment()
        p = F.round(priority(F.col("cluster_size"), F.col("canonical_salience"), F.col("staged_at"), now), 6)
        return candidates.join(staged, "id", "left_semi").withColumn("priority", p).orderBy(F.desc("priority"), "id").limit(k)
