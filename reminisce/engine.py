"""One object over a store: take in, compact, assemble, search, describe, expand, and look after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.operators import assemble, compact, dag, ingest, listing, maintain, search, status
from reminisce.sources.tables import conversations, messages


class Engine:
    """The store of a folder's conversations. Every method gives a table; nothing is changed in place."""

    def __init__(self, spark: SparkSession, sf_dir: str, threshold: int = 150, tail: int = 2, fanout: int = 2):
        self.spark, self.messages, self.conversations = spark, messages(spark, sf_dir), conversations(spark, sf_dir)
        self.options = {"threshold": threshold, "tail": tail, "fanout": fanout}
        self._store: compact.Store | None = None

    def compact(self) -> compact.Store:
        """The compacted store, made once."""
        if self._store is None:
            self._store = compact.kept(compact.sweep(self.messages, **self.options))
        return self._store

    def ingest(self, batch: DataFrame, key: str | None = None) -> DataFrame:
        """Stored messages with what of the batch is new, numbered on."""
        fresh = batch if key is None else ingest.once(batch, self.messages, key)
        self.messages = self.messages.unionByName(ingest.next_seq(fresh, self.messages).select(*self.messages.columns))
        self._store = None
        return self.messages

    def assemble(self, budget: int, n: int | None = None) -> DataFrame:
        return assemble.assemble(self.compact(), budget, n or self.options["tail"])

    def grep(self, query: str, scope: str = "both", mode: str = "full_text", sort: str = "recency", as_of: str = "2024-02-01 00:00:00", limit: int = 50, conversation_ids: list[int] | None = None) -> DataFrame:
        """kind, id, conversation_id, created_at and content of what matches among messages, summaries or both."""
        arms = []
        if scope in ("messages", "both"):
            m = search.search(listing.scope(self.messages, conversation_ids), query, mode, sort, as_of, limit)
            arms.append(m.select(F.lit("message").alias("kind"), F.col("message_id").cast("string").alias("id"), "conversation_id", "created_at", "content"))
        if scope in ("summaries", "both"):
            s = listing.scope(self.compact().summaries, conversation_ids).select(F.col("summary_id").alias("message_id"), "conversation_id", F.col("latest_at").alias("created_at"), "content")
            found = search.search(s, query, mode, sort, as_of, limit)
            arms.append(found.select(F.lit("summary").alias("kind"), F.col("message_id").alias("id"), "conversation_id", "created_at", "content"))
        out = arms[0]
        for arm in arms[1:]:
            out = out.unionByName(arm)
        return out

    def describe(self, summary_id: str) -> DataFrame:
        return dag.describe(self.compact()).filter(F.col("summary_id") == summary_id)

    def expand(self, summary_ids: list[str], token_cap: int = 4000, include_messages: bool = True, max_depth: int | None = None) -> DataFrame:
        store = self.compact()
        return dag.expand(store, store.summaries.filter(F.col("summary_id").isin(summary_ids)), token_cap, include_messages, max_depth)

    def expand_query(self, query: str, token_cap: int = 4000, limit: int = 20) -> DataFrame:
        """What the summaries that match a query, or the leaves of matching messages, expand to."""
        store = self.compact()
        hits = self.grep(query, "summaries", limit=limit).select(F.col("id").alias("summary_id"))
        leaves = dag.leaves_of_messages(self.grep(query, "messages", limit=limit).select(F.col("id").cast("long").alias("message_id")), store).select("summary_id")
        return dag.expand(store, hits.unionByName(leaves).distinct(), token_cap)

    def status(self) -> DataFrame:
        return status.totals(self.compact(), self.conversations)

    def doctor(self) -> DataFrame:
        store = self.compact()
        return maintain.doctor_targets(store.summaries, store.summary_edges, store.context_items)

    def prune(self, cutoff: str) -> dict[str, DataFrame]:
        """The tables without conversations that ended before the cutoff."""
        gone = maintain.prune_candidates(self.conversations, self.messages, cutoff)
        return maintain.prune({"conversations": self.conversations, "messages": self.messages, "context_items": self.compact().context_items, "summaries": self.compact().summaries}, gone)

    def backup(self, path: str) -> list[str]:
        """Every table as Parquet below a path; the names written."""
        store = self.compact()
        tables = {"conversations": self.conversations, "messages": self.messages, "summaries": store.summaries, "summary_messages": store.summary_messages, "summary_edges": store.summary_edges, "context_items": store.context_items}
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")
        return list(tables)
