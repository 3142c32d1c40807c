"""A coding stream that knows, over batches and restarts, which post is the hundredth to save and which review is due.

Posts are dealt to lanes (a worker's share of a session); each lane is a key of its
own state, so lanes go on side by side and no task has them all. A lane's state is the
number of posts so far and the best candidates for its next review, at most
``2 * most`` of them however long the stream is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from colloquy.streaming import folders

SAVE_EVERY, REVIEW_EVERY = 100, 500
SHARE, MOST = 0.2, 20
#: Posts of a lane that are numbered and picked from at once, about.
ROWS_AT_ONCE = 50_000
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Numbering(StatefulProcessor):
    """Numbers the posts of a lane and picks each review as soon as its last post is there.

    A review is a fifth of its posts, 1 to ``most``: flagged ones first (by order of
    arrival), then others by a draw that depends on the post alone.
    """

    def __init__(self, save_every: int, review_every: int, share: float, most: int) -> None:
        self.save_every, self.review_every, self.share, self.most = save_every, review_every, share, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.due = handle.getListState("due", "id string, number long, flagged boolean, draw string")

    def _best(self, rows: pd.DataFrame) -> pd.DataFrame:
        """What a review may still need of ``rows``: no more than ``most`` of each kind."""
        flagged = rows[rows["flagged"]].nsmallest(self.most, "number")
        others = rows[~rows["flagged"]].sort_values(["draw", "number"]).head(self.most)
        return pd.concat([flagged, others])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch and lane in order of arrival, as Arrow: Python texts would take several times their room.
        posts = pa.concat_tables([pa.Table.from_pandas(r[["id", "order", "flagged", "draw"]], preserve_index=False) for r in rows], promote_options="permissive").combine_chunks()
        arrival = pc.sort_indices(posts, [("order", "ascending"), ("id", "ascending")])
        n = int(self.count.get()[0]) if self.count.exists() else 0
        due = pd.DataFrame(list(self.due.get()) if self.due.exists() else [], columns=["id", "number", "flagged", "draw"]).astype({"flagged": bool, "number": "int64"})
        lane, size = key[0], max(1, ROWS_AT_ONCE // self.review_every) * self.review_every
        for at in range(0, len(arrival), size):
            block = posts.select(["id", "flagged", "draw"]).take(arrival.slice(at, size)).to_pandas().astype({"flagged": bool})
            block["number"] = range(n + 1, n + 1 + len(block))
            n += len(block)
            yield self._shown(lane, "post", block)
            picked, due = self._picked(pd.concat([due, block]), n // self.review_every)
            yield self._shown(lane, "review", picked)
        self.count.update((n,))
        if len(due):
            self.due.put([(r.id, int(r.number), bool(r.flagged), r.draw) for r in due.itertuples()])
        else:
            self.due.clear()

    def _shown(self, lane: str, kind: str, rows: pd.DataFrame) -> pd.DataFrame:
        before = rows["number"] - 1
        return pd.DataFrame({"lane": lane, "kind": kind, "id": rows["id"], "number": rows["number"], "save": before // self.save_every + 1, "review": before // self.review_every + 1})

    def _picked(self, rows: pd.DataFrame, complete: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The rows picked for all reviews that are complete, and what the next may still need. All reviews are sorted at once."""
        review = ((rows["number"] - 1) // self.review_every + 1).to_numpy()
        flagged = rows["flagged"].to_numpy()
        place = pa.table({"review": review, "other": ~flagged, "draw": pa.array(rows["draw"].where(~rows["flagged"], ""), pa.string()), "number": rows["number"].to_numpy()})
        order = pc.sort_indices(place, [(c, "ascending") for c in place.column_names]).to_numpy()
        order = order[review[order] <= complete]
        inside = np.arange(len(order)) - np.searchsorted(review[order], review[order])
        take = min(max(int(self.review_every * self.share), 1), self.most)
        return rows.iloc[order[inside < take]], self._best(rows[review > complete])

    def close(self) -> None:
        pass


OUT = "lane string, kind string, id string, number long, save long, review long"


def number_posts(stream: DataFrame, lane: Column, key: str, order: str, flagged: Column, seed: int = 0, save_every: int = SAVE_EVERY, review_every: int = REVIEW_EVERY, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(lane, kind, id, number, save, review): every post with its number, save and review, and the posts of each complete review once more.

    Posts of one batch are numbered by ``order`` and key, batches as they come: the same
    posts in the same order get the same numbers, whichever files and batches hold them.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    rows = stream.select(lane.cast("string").alias("lane"), F.col(key).cast("string").alias("id"), F.col(order).alias("order"), F.coalesce(flagged, F.lit(False)).alias("flagged"), draw.alias("draw"))
    return rows.groupBy("lane").transformWithStateInPandas(Numbering(save_every, review_every, share, most), OUT, "Append", "None")


def code_with_reviews(numbered: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what ``number_posts`` makes; a run takes all there is and stops, the next one goes on from the state."""
    spark, (key, value) = numbered.sparkSession, _ROCKS
    given = spark.conf.get(key, None)
    spark.conf.set(key, value)  # the only store that holds several states of a key; a query takes it as it starts
    try:
        write = lambda batch, number: folders.write_batch(batch, out, number)
        return numbered.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, given) if given else spark.conf.unset(key)


def coded(spark: SparkSession, out: str, kind: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(out).where(F.col("kind") == kind).select("lane", "id", "number", "save", "review")


def complete_saves(spark: SparkSession, out: str, save_every: int = SAVE_EVERY) -> DataFrame:
    """(lane, save, n, complete): the saves of each lane; only the last one may be open."""
    saves = coded(spark, out, "post").groupBy("lane", "save").agg(F.count("*").alias("n"))
    return saves.withColumn("complete", F.col("n") == save_every)
