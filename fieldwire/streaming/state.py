"""Keyed state of the live detectors.

Keys are dealt to buckets by hash, and a bucket is one group of Spark's, so that calls and state accesses are paid
per bucket, not per key. Rows come to it packed, many as one binary value: Spark hands a group over row by row, which
costs more than all that is done with the rows. They wait as they came until the watermark has passed their time, and
are then taken key by key in the order of their times by array operations. What a detector carries from there on is a bounded
value a key: a last firing, the stamps of one window, the counters of one flow, or the alerts of one time-to-live. A
row that comes when the watermark has already passed its time is handed on as it is, marked ``late``, and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import ATTACK_CLASSES, FC_FEATURES, LINK_STATUS_CTRL


#: Column of the bucket that a key is dealt to.
BUCKET = "__bucket"
#: Rows of one bucket as they reach its processor: the time of the first, and all of them packed.
PACKED = f"{BUCKET} INT, first_us LONG, rows BINARY"
#: Rows that a task holds to pack those of a bucket together.
PACK_ROWS = 1 << 17


def packed(rows: pd.DataFrame | pa.Table) -> bytes:
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    # threads cost ten times the work on so few rows
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(*data: bytes) -> pd.DataFrame:
    plain = pa.ipc.IpcReadOptions(use_threads=False)
    return pa.concat_tables([pa.ipc.open_stream(x, options=plain).read_all() for x in data], promote_options="permissive").to_pandas()


def pack_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PACKED`` rows of rows with a ``BUCKET``, whose order inside a bucket stays."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= PACK_ROWS:
            yield _by_bucket(held)
            held, n = [], 0
    if n:
        yield _by_bucket(held)


def _by_bucket(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    bucket = table.column(BUCKET).to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket, table = bucket[order], table.drop_columns([BUCKET]).take(pa.array(order)).combine_chunks()
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    first = np.minimum.reduceat(table.column("ts_us").to_numpy(), cuts[:-1])
    rows = [packed(table.slice(s, e - s)) for s, e in zip(cuts.tolist(), cuts[1:].tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(first, pa.int64()), pa.array(rows, pa.binary())], [BUCKET, "first_us", "rows"])


def due_ms(ts_us: int) -> int:
    """The first watermark in milliseconds that has passed a time."""
    return int(ts_us) // 1000 + 1


class Ordered(StatefulProcessor):
    """Takes the rows of a bucket's keys in order; ``step`` says what comes of them.

    ``columns`` are those of the results, of which a late row fills what it has."""

    def __init__(self, keys: list[str], columns: list[str], order: list[str]):
        self.keys, self.columns, self.order = keys, columns, order

    def step(self, rows: pd.DataFrame | None, held: pd.DataFrame | None, now_us: int) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        """From the next ``rows`` (maybe none), the table held and the watermark: results, the table to hold, and the
        watermark at which to be asked again without new rows.

        Both tables have the key columns and ``__k``, a number for each key; rows lie in order by ``__k`` and the order."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.value = handle.getValueState("value", "held BINARY")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        first, behind = [], []
        for part in rows:
            for at, data in zip(part["first_us"].tolist(), part["rows"]):
                if at < now_us:
                    behind.append(data)
                else:
                    first.append(at)
                    self.waiting.appendValue((data,))
        if behind:
            batch = unpacked(*behind)
            late = batch["ts_us"].to_numpy() < now_us
            fresh = batch[~late]
            if len(fresh):
                first.append(fresh["ts_us"].min())
                self.waiting.appendValue((packed(fresh),))
            yield self._shaped(batch[late], True)
        if first:
            self.handle.registerTimer(due_ms(min(first)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        rows = unpacked(*parts) if parts else None
        held = unpacked(self.value.get()[0]) if self.value.exists() else None
        if rows is not None:
            ready = rows["ts_us"].to_numpy() < now_us
            rest, rows = rows[~ready], rows[ready]
            if not len(rest):
                self.waiting.clear()
            else:
                if len(rows):
                    self.waiting.put([(packed(rest),)])
                self.handle.registerTimer(due_ms(rest["ts_us"].min()))
            rows = rows if len(rows) else None
        if rows is None and held is None:
            return
        self._number(rows, held)
        if rows is not None:
            rows = rows.sort_values(["__k", *self.order], kind="stable", ignore_index=True)
        out, held, ask = self.step(rows, held, now_us)
        if held is not None and len(held):
            self.value.update((packed(held.drop(columns="__k")),))
        elif self.value.exists():
            self.value.clear()
        if ask is not None:
            self.handle.registerTimer(ask)
        if out is not None and len(out):
            yield self._shaped(out, False)

    def _number(self, *tables: pd.DataFrame | None) -> None:
        """Adds ``__k``; null keys are keys."""
        there = [t for t in tables if t is not None]
        number = pd.concat([t[self.keys] for t in there], ignore_index=True).groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        for t in there:
            t["__k"], number = number[:len(t)], number[len(t):]

    def _shaped(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        void = {c: None for c in self.columns if c not in rows.columns}
        return rows.assign(**void)[self.columns].assign(late=late)

    def close(self) -> None:
        pass


def _stamps(rows: pd.DataFrame) -> np.ndarray:
    return rows["ts_us"].to_numpy(np.int64)


def _firings(number: np.ndarray, stamps: np.ndarray, gap_us: int, last: dict[int, int]) -> list[int]:
    """Rows that pass, each at least ``gap_us`` after the last that passed of its key; ``last`` is kept up to date."""
    keep = []
    cuts = np.flatnonzero(np.diff(number, prepend=-1, append=-1)).tolist() if len(number) else []
    for s, e in zip(cuts, cuts[1:]):
        k, mine, at = int(number[s]), stamps[s:e], 0
        before = last.get(k)
        while True:
            if before is not None:
                at = max(at, int(mine.searchsorted(before + gap_us)))
            if at >= e - s:
                break
            keep.append(s + at)
            before = int(mine[at])
            at += 1
        last[k] = before
    return keep


def _keys_of(keys: list[str], *tables: pd.DataFrame | None) -> pd.DataFrame:
    """One row a key, by its number."""
    return pd.concat([t[["__k", *keys]] for t in tables if t is not None], ignore_index=True).drop_duplicates("__k").set_index("__k")


def _held(named: pd.DataFrame, numbers: list[int], **columns) -> pd.DataFrame:
    return named.loc[numbers].reset_index().assign(**columns)


class Cooldown(Ordered):
    """Passes a row when the key's last passed row is at least ``cooldown_us`` old."""

    def __init__(self, keys: list[str], columns: list[str], order: list[str], cooldown_us: int):
        super().__init__(keys, columns, order)
        self.cooldown_us = cooldown_us

    def step(self, rows, held, now_us):
        last = dict(zip(held["__k"].tolist(), held["last"].tolist())) if held is not None else {}
        out = None if rows is None else rows.iloc[_firings(rows["__k"].to_numpy(), _stamps(rows), self.cooldown_us, last)]
        last = {k: t for k, t in last.items() if t + self.cooldown_us > now_us}
        if not last:
            return out, None, None
        keep = _held(_keys_of(self.keys, rows, held), list(last), last=list(last.values()))
        return out, keep, due_ms(max(last.values()) + self.cooldown_us)


class ScanBurst(Ordered):
    """Passes a row when its key saw ``threshold`` rows in the window, then rests a window."""

    def __init__(self, keys: list[str], columns: list[str], order: list[str], threshold: int, window_us: int):
        super().__init__(keys, columns, order)
        self.threshold, self.window_us = threshold, window_us

    def step(self, rows, held, now_us):
        # held: one row a stamp of the window and one, with ``fired``, a last firing
        last, parts = {}, []
        if held is not None:
            fired = held["fired"].to_numpy(bool)
            last = dict(zip(held["__k"][fired].tolist(), held["ts_us"][fired].tolist()))
            parts.append(held.loc[~fired, ["__k", "ts_us"]].assign(__at=-1))
        if rows is not None:
            parts.append(rows[["__k", "ts_us"]].assign(__at=np.arange(len(rows))))
        merged = pd.concat(parts, ignore_index=True).sort_values(["__k", "ts_us", "__at"], kind="stable")
        number, stamps, at = merged["__k"].to_numpy(), _stamps(merged), merged["__at"].to_numpy()
        # keys and times as one number in order, times by rank
        times = np.unique(stamps)
        upto = np.arange(1, len(stamps) + 1)
        place = number * (len(times) + 1) + np.searchsorted(times, stamps)
        opened = np.searchsorted(place, number * (len(times) + 1) + np.searchsorted(times, stamps - self.window_us))
        out = None
        if rows is not None:
            dense = np.sort(at[(at >= 0) & (upto - opened >= self.threshold)])
            kept = _firings(rows["__k"].to_numpy()[dense], _stamps(rows)[dense], self.window_us, last)
            out = rows.iloc[dense[kept]]
        last = {k: t for k, t in last.items() if t + self.window_us > now_us}
        recent = stamps >= now_us - self.window_us
        numbers = [*number[recent].tolist(), *last]
        if not numbers:
            return out, None, None
        at_us = [*stamps[recent].tolist(), *last.values()]
        keep = _held(_keys_of(self.keys, rows, held), numbers, ts_us=at_us, fired=[False] * int(recent.sum()) + [True] * len(last))
        return out, keep, due_ms(max(at_us) + self.window_us)


class FlowSession(Ordered):
    """Counts the frames of a flow and emits the features when the flow is idle or ends."""

    SUMS = ["total", "fwd", "attack", "link", "users", "user_sum"]

    def __init__(self, keys: list[str], features: list[str], idle_us: int):
        super().__init__(keys, [*keys, "start_us", "end_us", *features], ["ts_us", "pkt_no", "frame_no"])
        self.features, self.idle_us = features, idle_us

    def step(self, rows, held, now_us):
        flows, codes = self._opened(held), self._codes(held)
        if rows is not None:
            flows, codes = self._counted(rows, flows, codes)
        done = flows["done"].to_numpy(bool) | (flows["seen"].to_numpy(np.int64) + self.idle_us < now_us)
        named = _keys_of(self.keys, rows, held)
        out = self._rows(named, flows[done], codes) if done.any() else None
        flows = flows[~done].drop(columns="done")
        if not len(flows):
            return out, None, None
        per = codes[codes["rec"].isin(flows.index)].groupby("rec").agg(list)
        per = per.reindex(flows.index)
        lists = {c: [x if isinstance(x, list) else [] for x in per[c]] for c in ("fc", "n", "first")}
        keep = named.loc[flows["__k"]].reset_index().assign(**{c: flows[c].to_numpy() for c in flows.columns if c != "__k"}, **lists)
        return out, keep, due_ms(int(flows["seen"].min()) + self.idle_us)

    def _opened(self, held: pd.DataFrame | None) -> pd.DataFrame:
        names = ["__k", "start", "seen", *self.SUMS, "user_max", "user_min"]
        flows = pd.DataFrame({c: np.zeros(0, np.int64) for c in names}) if held is None else held[names].reset_index(drop=True)
        return flows.assign(done=False)

    @staticmethod
    def _codes(held: pd.DataFrame | None) -> pd.DataFrame:
        """(rec, fc, n, first): how often each code came in a flow and as which of its frames first."""
        if held is None:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rec", "fc", "n", "first")})
        rec = np.repeat(np.arange(len(held)), [len(x) for x in held["fc"]])
        return pd.DataFrame({"rec": rec, **{c: np.concatenate([np.asarray(x, np.int64) for x in held[c]]) for c in ("fc", "n", "first")}})

    def _counted(self, rows: pd.DataFrame, flows: pd.DataFrame, codes: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Flows held and those of the rows, the codes of all; a flow that goes on has its counters added up."""
        number, ends = rows["__k"].to_numpy(np.int64), rows["ends"].to_numpy(bool)
        upto = np.cumsum(ends)
        before = upto - ends  # endings ahead of each row
        size = int(max(number.max(), flows["__k"].max() if len(flows) else 0)) + 1
        opened, closed = np.zeros(size, np.int64), np.zeros(size, np.int64)  # endings before and after a key's rows
        head = np.flatnonzero(np.diff(number, prepend=-1))
        opened[number[head]], closed[number[head]] = before[head], upto[np.append(head[1:], len(number)) - 1]
        held_at = np.full(size, -1)
        held_at[flows["__k"].to_numpy()] = np.arange(len(flows))
        ended = np.zeros(size, bool)
        ended[number[head]] = closed[number[head]] > opened[number[head]]
        done = ended[flows["__k"].to_numpy()] if len(flows) else np.zeros(0, bool)  # unless it goes on
        at = np.flatnonzero(rows["ctrl"].notna().to_numpy())
        if not len(at):
            return flows.assign(done=done), codes
        f, k, stamps, ahead = rows.iloc[at], number[at], _stamps(rows)[at], before[at]
        first = np.diff(k, prepend=-1) != 0
        new = first | (np.diff(stamps, prepend=0) > self.idle_us) | (np.diff(ahead, prepend=0) > 0)
        starts = np.flatnonzero(new)
        mine = k[starts]
        old = np.where(first[starts], held_at[mine], -1)
        seen = flows["seen"].to_numpy(np.int64)
        goes_on = old >= 0
        goes_on[goes_on] = (ahead[starts] == opened[mine])[goes_on] & (stamps[starts][goes_on] - seen[old[goes_on]] <= self.idle_us)
        done[old[(old >= 0) & ~goes_on]] = True
        stops = np.append(starts[1:], len(at))
        is_last = np.append(mine[1:] != mine[:-1], True)
        fc, udata = f["fc"].to_numpy(float), np.nan_to_num(f["user_data_len"].to_numpy(float)).astype(np.int64)
        known = ~np.isnan(fc)
        code = np.where(known, fc, -1).astype(np.int64)
        add = lambda x: np.add.reduceat(x.astype(np.int64), starts)
        made = pd.DataFrame({
            "__k": mine, "start": stamps[starts], "seen": stamps[stops - 1], "total": stops - starts, "fwd": add(f["is_fwd"].to_numpy(bool)),
            "attack": add(np.isin(code, list(ATTACK_CLASSES))), "link": add(f["ctrl"].to_numpy() == LINK_STATUS_CTRL),
            "users": add(udata > 0), "user_sum": add(np.maximum(udata, 0)), "user_max": np.maximum.reduceat(np.maximum(udata, 0), starts),
            "user_min": np.minimum.reduceat(np.where(udata > 0, udata, _NO_MIN), starts),
            "done": ~is_last | (closed[mine] > before[at[stops - 1]])})
        rec = np.repeat(np.arange(len(starts)), stops - starts)
        nth = np.arange(len(at)) - starts[rec] + 1
        # a held flow that goes on is the start of the made one
        on, was = np.flatnonzero(goes_on), old[goes_on]
        for c in self.SUMS:
            made[c] = made[c].to_numpy() + _spread(flows[c].to_numpy(np.int64), was, on, len(made))
        nth = nth + _spread(flows["total"].to_numpy(np.int64), was, on, len(made))[rec]
        user_min = flows["user_min"].to_numpy(np.int64)
        made["user_max"] = np.maximum(made["user_max"], _spread(flows["user_max"].to_numpy(np.int64), was, on, len(made)))
        least = _spread(np.where(user_min > 0, user_min, _NO_MIN), was, on, len(made), _NO_MIN)
        made["user_min"] = np.minimum(made["user_min"], least)
        made["user_min"] = made["user_min"].where(made["users"] > 0, 0)
        made.loc[on, "start"] = flows["start"].to_numpy()[was]
        place = np.arange(len(flows)) + len(made)  # records held come after those made
        place[was] = on
        found = pd.DataFrame({"rec": rec[known], "fc": code[known], "n": 1, "first": nth[known]})
        codes = pd.concat([codes.assign(rec=place[codes["rec"].to_numpy(np.int64)]), found]).groupby(["rec", "fc"], as_index=False).agg(n=("n", "sum"), first=("first", "min"))
        flows = flows.assign(done=done).set_axis(place)
        return pd.concat([made, flows.drop(index=on)]), codes

    def _rows(self, named: pd.DataFrame, flows: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        codes = codes[codes["rec"].isin(flows.index)]
        per = codes.groupby("rec").size().reindex(flows.index, fill_value=0)
        top = codes.sort_values(["rec", "n", "first"], ascending=[True, False, True]).drop_duplicates("rec").set_index("rec")["fc"]
        total, users = flows["total"], flows["users"]
        values = {
            "total_frames": total, "fwd_frames": flows["fwd"], "bwd_frames": total - flows["fwd"], "response_ratio": (total - flows["fwd"]) / total,
            "attack_fc_count": flows["attack"], "attack_fc_ratio": flows["attack"] / total, "link_status_count": flows["link"],
            "link_status_ratio": flows["link"] / total, "unique_fcs": per, "most_common_req_fc": top.reindex(flows.index, fill_value=-1),
            **{name: codes[codes["fc"] == c].set_index("rec")["n"].reindex(flows.index, fill_value=0) for name, c in FC_FEATURES.items()},
            "mean_udata_len": (flows["user_sum"] / users.where(users > 0, 1)), "max_udata_len": flows["user_max"], "min_udata_len": flows["user_min"],
        }
        out = named.loc[flows["__k"]].reset_index(drop=True)
        return out.assign(start_us=flows["start"].to_numpy(), end_us=flows["seen"].to_numpy(), **{c: values[c].to_numpy() for c in self.features})


_NO_MIN = np.iinfo(np.int64).max


def _spread(values: np.ndarray, take: np.ndarray, at: np.ndarray, n: int, void: int = 0) -> np.ndarray:
    """``values[take]`` at the places ``at`` of ``n``, ``void`` elsewhere."""
    out = np.full(n, void, np.int64)
    out[at] = values[take]
    return out


class Suppress(Ordered):
    """Looks for the latest alert that covers a verdict: on its own 4-tuple, else on the reversed one."""

    def __init__(self, keys: list[str], ttl_us: int):
        super().__init__(keys, [*keys, "body", "sig_id", "sig_name", "covered"], ["ts_us"])
        self.ttl_us = ttl_us

    def step(self, rows, held, now_us):
        known, out = held, None
        if rows is not None:
            is_alert = rows["is_alert"].to_numpy(bool)
            known = pd.concat([*([] if held is None else [held]), rows.loc[is_alert, ["__k", *self.keys, "ts_us", "is_ab", "sig_id", "sig_name"]]], ignore_index=True)
            out = rows[~is_alert]
        known = known.sort_values(["__k", "is_ab", "ts_us", "sig_id", "sig_name"], kind="stable", ignore_index=True)
        if out is not None and len(out):
            out = self._covered(out, known)
        recent = known[known["ts_us"] >= now_us - self.ttl_us]
        if not len(recent):
            return out, None, None
        return out, recent, due_ms(recent["ts_us"].max() + self.ttl_us)

    def _covered(self, verdicts: pd.DataFrame, alerts: pd.DataFrame) -> pd.DataFrame:
        stamps, hit = _stamps(verdicts), np.full(len(verdicts), -1)
        if len(alerts):
            at, times = _stamps(alerts), np.unique(_stamps(alerts))
            side = alerts["__k"].to_numpy(np.int64) * 2 + alerts["is_ab"].to_numpy(bool)
            place = side * (len(times) + 1) + np.searchsorted(times, at)
            for other in (False, True):
                want = verdicts["__k"].to_numpy(np.int64) * 2 + (verdicts["is_ab"].to_numpy(bool) ^ other)
                last = np.searchsorted(place, want * (len(times) + 1) + np.searchsorted(times, stamps, "right")) - 1
                found = np.maximum(last, 0)
                good = (hit < 0) & (last >= 0) & (side[found] == want) & (at[found] >= stamps - self.ttl_us)
                hit[good] = found[good]
        ids = alerts["sig_id"].astype("Int64").take(np.maximum(hit, 0)) if len(alerts) else pd.Series([pd.NA] * len(hit), dtype="Int64")
        names = alerts["sig_name"].take(np.maximum(hit, 0)) if len(alerts) else pd.Series([None] * len(hit), dtype=object)
        miss = hit < 0
        return verdicts[[*self.keys, "body"]].assign(sig_id=ids.mask(miss).array, sig_name=names.mask(miss, None).array, covered=~miss)
