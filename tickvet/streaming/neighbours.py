"""Rules that look at a bar's neighbours, over a stream: gaps, order, runs of equal closes, unadjusted splits.

Bars are dealt by dataset and brought into the order of seq, whatever the order in which they arrive: a bar waits in the
state until the one before it is there. So what is found of a stream is what is found of its bars at once. A dataset that
has more than `most_held` bars waiting at the end of a micro-batch gives the missing ones up; bars that come after that, a
seq that comes again, and bars without seq are `late`: they pass, without neighbours, and no rule looks at them.

State of a dataset: the last bar, the run that it belongs to, and the bars that wait (most_held at most between batches;
a micro-batch holds a dataset's bars of that batch in one task). Datasets are dealt to `buckets` by hash, and a bucket is one
group of the stream: a call and its frames cost about the same for a bar as for hundreds. NaN becomes null on the way; rules treat both alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickvet.functions import DAY_MS, split_label
from tickvet.operators.bands import band_join
from tickvet.operators.catalog import CHECK_RULES
from tickvet.operators.rules import RowRule, bar_missing, hit, split_evidence, stale_price, ts_unordered
from tickvet.operators.tables import BARS

BEFORE = "p_close double, p_volume double, p_t long, p_raw string, p_seq int, run_n long, run_seq int, run_raw string, run_traded int"
STATE = "datasets string"  # JSON: of each dataset of a bucket its id, the next seq, NAMES of its last bar, and the bars that wait
NAMES = [c.split()[0] for c in BEFORE.split(", ")]
BAR_NAMES = [c.split()[0] for c in BARS.split(", ")]
BUCKETS = 1 << 14


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    """The values of BAR_NAMES by row; what is null or NaN is None."""
    columns = [[None if v is None or v != v else v for v in frame[c].tolist()] for c in BAR_NAMES]
    for c in ("seq", "t"):
        at = BAR_NAMES.index(c)
        columns[at] = [None if v is None else int(v) for v in columns[at]]
    return zip(*columns, strict=True)


def _follow(last: dict, bar: dict) -> dict:
    """What the next bar sees of this one, and the run of equal closes up to it."""
    same = last["p_seq"] is not None and bar["close"] is not None and bar["close"] == last["p_close"]
    traded = int(bar["volume"] is None or bar["volume"] > 0)
    run = (last["run_n"] + 1, last["run_seq"], last["run_raw"], max(last["run_traded"], traded)) if same else (1, bar["seq"], bar["ts_raw"], traded)
    return dict(zip(NAMES, (bar["close"], bar["volume"], bar["t"], bar["ts_raw"], bar["seq"], *run), strict=True))


def _in_order(most_held: int) -> Callable:
    def each(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {ds: [following, dict(zip(NAMES, before, strict=True)), {r[0]: (ds, *r) for r in held}] for ds, following, before, held in json.loads(state.get[0])} if state.exists else {}

        def ready(of: list, give_up: bool) -> Iterator[tuple]:
            following, last, held = of
            while held:
                if following not in held:
                    if not give_up or len(held) <= most_held:
                        break
                    following = min(held)
                bar = held.pop(following)
                after = _follow(last, dict(zip(BAR_NAMES, bar, strict=True)))
                yield (*bar, *(last[k] for k in NAMES[:5]), *(after[k] for k in NAMES[5:]), False)
                last, following = after, following + 1
            of[:2] = following, last

        def out(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[*BAR_NAMES, *NAMES, "late"], dtype=object)

        came: set[str | None] = set()
        for frame in frames:
            done, here = [], set()
            for r in _rows(frame):
                ds, seq = r[:2]
                if ds not in known:
                    known[ds] = [0, dict.fromkeys(NAMES), {}]
                following, _, held = known[ds]
                if seq is None or seq < following or seq in held:
                    done.append((*r, *[None] * len(NAMES), True))
                else:
                    held[seq] = r
                    here.add(ds)
            for ds in here:
                done.extend(ready(known[ds], False))
            came |= here
            if done:
                yield out(done)
        rest = [r for ds in came for r in ready(known[ds], True)]
        if rest:
            yield out(rest)
        state.update((json.dumps([(ds, following, [last[k] for k in NAMES], [r[1:] for r in held.values()]) for ds, (following, last, held) in known.items()]),))

    return each


def with_neighbours(bars: DataFrame, most_held: int = 1000, buckets: int = BUCKETS) -> DataFrame:
    """A stream of bars, each once, with the bar before it (p_*), its return, the run of equal closes up to it (run_*) and late."""
    dealt = bars.select(*BAR_NAMES, F.pmod(F.xxhash64("dataset_id"), F.lit(buckets)).alias("bucket"))
    got = dealt.groupBy("bucket").applyInPandasWithState(_in_order(most_held), f"{BARS}, {BEFORE}, late boolean", STATE, "append", GroupStateTimeout.NoTimeout)
    both = (F.col("close") > 0) & (F.col("p_close") > 0)
    return got.withColumn("ret", F.when(both, F.try_divide(F.col("close"), F.col("p_close")) - 1))


def _split(p):
    return [hit("SPLIT_NOT_ADJUSTED", F.col("ratio").isNotNull(), F.col("ts_raw"), F.col("ret"), split_evidence(), F.col("seq"))]


def _run(p):
    # k2 tells the run; settled() keeps the last of each.
    return [h.withField("k2", F.col("run_seq").cast("long")) for h in stale_price.hits(p)]


NEIGHBOUR = {
    "SPLIT_NOT_ADJUSTED": RowRule("enriched", _split, lambda p: [{"ratio": split_label(F.col("ret"), p["tolerance"])}]), "TS_UNORDERED": ts_unordered, "BAR_MISSING": bar_missing,
    "STALE_PRICE": RowRule("enriched", _run, lambda p: [{"run_last": F.col("seq"), "run_from": F.struct(F.col("run_seq").alias("seq"), F.col("run_raw").alias("ts_raw"))}]),
}


def neighbour_occurrences(bars: DataFrame, splits: DataFrame, most_held: int = 1000) -> DataFrame:
    """Occurrences in a stream of bars, told with the bar that shows them; splits is a table that is read anew each batch.

    A run of equal closes is told again with each bar that lengthens it: its k2 is the seq at which it began.
    """
    rows, found, params = with_neighbours(bars, most_held).filter("NOT late"), [], {r: CHECK_RULES[r].params for r in NEIGHBOUR}
    for r, rule in NEIGHBOUR.items():
        for step in rule.columns(params[r]):
            rows = rows.withColumns(step)
        found += rule.hits(params[r])
    told = rows.select("dataset_id", "t", F.explode(F.array_compact(F.array(*found))).alias("o")).select("dataset_id", "t", "o.*")
    days = params["SPLIT_NOT_ADJUSTED"]["splitWindowDays"] * DAY_MS
    known = splits.select(F.col("dataset_id").alias("ds"), F.col("ex_t").alias("split_t"))
    on = (F.col("rule") == "SPLIT_NOT_ADJUSTED") & (F.abs(F.col("split_t") - F.col("t")) <= days)
    return band_join(told, known, {"dataset_id": "ds"}, "t", "split_t", -days, days, on, "left_anti").drop("t")


def settled(told: DataFrame) -> DataFrame:
    """What neighbour_occurrences() has told so far, each run once, as the batch rules tell it."""
    run = F.when(F.col("rule") == "STALE_PRICE", F.col("k2")).otherwise(-F.col("k1") - 1)
    last = Window.partitionBy("dataset_id", "rule", "run").orderBy(F.desc("k1"))
    kept = told.withColumn("run", run).withColumn("r", F.row_number().over(last)).filter("r = 1")
    return kept.withColumn("k2", F.lit(0).cast("long")).select(told.columns)
