"""Life of stored payloads: placement in a ring, occupancy, second-chance eviction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PAYLOAD_HEADER_BYTES
from ..scale import running, ship

def placement(payloads: DataFrame, row_id: str, n_bytes: str, header: int = PAYLOAD_HEADER_BYTES, width: int = 50_000) -> DataFrame:
    """(row_id, n_bytes, voffset): virtual offsets of payloads written in order of id, each behind its header."""
    sized = payloads.where(F.col(row_id).isNotNull() & F.col(n_bytes).isNotNull()).select(row_id, n_bytes)
    run = running(sized, [], row_id, F.col(n_bytes) + header, "ends", width)
    return run.select(row_id, n_bytes, (F.col("ends") - F.col(n_bytes) - header).alias("voffset"))

def fifo(rows: DataFrame, order: str, capacity: int, width: int = 50_000) -> DataFrame:
    """``rows`` with ``place`` (from 1, by the unique ``order``) and ``admitted``: whether a queue of ``capacity`` that nothing
    has left yet takes the row. A full queue refuses; what is taken out goes in order of place. Rows without an order go."""
    run = running(rows.where(F.col(order).isNotNull()), [], order, F.lit(1), "place", width)
    return run.withColumn("admitted", F.col("place") <= capacity)


def clock(entries: DataFrame, ring: str, order: str, capacity: int) -> DataFrame:
    """(ring, order, fate): second-chance eviction of each ring down to ``capacity`` bytes, oldest first.

    ``entries`` has (ring, order, n_bytes, state, hot). Entries of state ORPHAN (their node is gone or points elsewhere, as
    a payload that was moved leaves behind) and dead ones are RECLAIMED, pending ones SKIPPED, cold ready
    ones EVICTED; hot ones are MOVED to the head as cold while room is short, and may be EVICTED on the next turn.
    Whatever is left is KEPT. A ring is sequential by nature: rings are the unit of distribution, and a ring's
    queue lives in its task, so rings are to be cut to bounded size (``clock_evict`` takes their number, by a hash).
    """
    ship(entries.sparkSession)

    def evict(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        fate = dict.fromkeys(pdf[order], "KEPT")
        used = int(pdf["n_bytes"].sum())
        queue = list(pdf[[order, "n_bytes", "state", "hot"]].itertuples(index=False, name=None))
        while used > capacity and queue:
            again = []
            for i, n, state, hot in queue:
                if used <= capacity:
                    break
                if state in ("DEAD", "ORPHAN"):
                    fate[i] = "RECLAIMED"
                    used -= n
                elif state == "PENDING":
                    fate[i] = "SKIPPED"
                elif hot:
                    fate[i] = "MOVED"
                    again.append((i, n, state, False))
                else:
                    fate[i] = "EVICTED"
                    used -= n
            queue = again
        return pd.DataFrame({ring: key[0], order: list(fate), "fate": list(fate.values())})

    kinds = dict(entries.dtypes)
    return entries.groupBy(ring).applyInPandas(evict, f"`{ring}` {kinds[ring]}, `{order}` {kinds[order]}, fate string")

