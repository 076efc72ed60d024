"""The state of :func:`jobs.reordered`: documents that wait for those before them."""

from pyspark.sql.streaming import StatefulProcessor


class Reorder(StatefulProcessor):
    """Holds the documents of one ordinal bucket until those before them have come.

    State: the next ordinal, what the bucket's documents sum up to so far, and the
    documents that came too early. A timer reports the document that is waited for.
    """

    def __init__(self, bucket_rows: int, num_val_docs: int, patience_ms: int):
        self.bucket_rows, self.num_val_docs, self.patience_ms = bucket_rows, num_val_docs, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next_ordinal BIGINT, docs BIGINT, tokens BIGINT")
        self.held = handle.getListState("held", "doc_ordinal BIGINT, n_tokens BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        split, bucket = key
        first = bucket * self.bucket_rows
        first = max(first, self.num_val_docs) if split == "train" else first
        next_, docs, tokens = self.place.get() if self.place.exists() else (first, 0, 0)
        waiting = dict(self.held.get()) if self.held.exists() else {}
        early = len(waiting)
        for frame in rows:
            for ordinal, n in zip(frame["doc_ordinal"].tolist(), frame["n_tokens"].tolist()):
                if ordinal < next_ or ordinal in waiting:
                    raise ValueError(f"document {ordinal} came twice")
                waiting[ordinal] = n
        out = []
        while next_ in waiting:
            n = waiting.pop(next_)
            out.append((split, bucket, "placed", next_, n, docs, tokens))
            next_, docs, tokens = next_ + 1, docs + 1, tokens + n
        self.place.update((next_, docs, tokens))
        if waiting:
            self.held.put(sorted(waiting.items()))
        elif early:
            self.held.clear()
        timers = list(self.handle.listTimers())
        if waiting and (out or not timers):
            # Time runs anew with every gap that closes.
            for at in timers:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        elif not waiting:
            for at in timers:
                self.handle.deleteTimer(at)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.held.exists():
            out.append((key[0], key[1], "missing", self.place.get()[0], len(list(self.held.get())), None, None))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield self._frame(out)

    def _frame(self, rows):
        import pandas as pd

        frame = pd.DataFrame(rows, columns=["split", "bucket", "kind", "doc_ordinal", "n_tokens", "bucket_ordinal", "bucket_offset"])
        return frame.astype({c: "Int64" for c in frame.columns if c not in ("split", "kind")})

    def close(self) -> None:
        pass
