"""Ordered folds over a recording: stretches, states and spans. Sorted rows stream through with a state per recording; no recording is gathered."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame

from screenlake.functions.folds import scan_sorted


def stretches(samples: DataFrame, line: float = 4.0) -> DataFrame:
    """(video, start, end, n, call, best_seq): runs that end when the call changes, or a screen differs from the run's first sample by more than the bound.

    ``samples`` has video, t, seq, call, level, frac and, if the bound is not ``line`` for all, bound.
    """

    def told(now: dict) -> list[tuple]:
        return [(now["video"], now["start"], now["end"], now["n"], now["call"], now["best_seq"])]

    def step(now: dict, row: tuple) -> list[tuple]:
        video, t, seq, call, level, frac, bound = row
        out = []
        if now and (call != now["call"] or (call == "screen" and abs(level - now["anchor"]) > bound)):
            out = told(now)
            now.clear()
        if not now:
            now |= {"video": video, "start": t, "call": call, "anchor": level, "n": 0, "frac": -1.0, "best_seq": seq}
        now["end"], now["n"] = t, now["n"] + 1
        if frac > now["frac"]:  # the earliest of equals stays
            now["frac"], now["best_seq"] = frac, seq
        return out

    s = samples if "bound" in samples.columns else samples.selectExpr("*", f"{line}D AS bound")
    return scan_sorted(s.select("video", "t", "seq", "call", "level", "frac", "bound"), "video", ["t", "seq"], "video long, start long, end long, n long, call string, best_seq long", step, told)


def _moments(step):
    """A step on the lines of each moment from one on single lines (video, ts, seq, said)."""

    def row_step(state: dict, row: tuple) -> list[tuple]:
        out = []
        if state.get("at") != row[1]:
            out = step(state, state["at"], state["said"]) if "at" in state else []
            state |= {"video": row[0], "at": row[1], "said": []}
        state["said"].append(row[3])
        return out

    return row_step


def window_states(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """(video, first, last, n, lines): states of a window in order of time. Equal content extends a state, a scrolled view is stitched on, likeness of ``least`` keeps the fuller reading, else a new state begins."""

    def told(now: dict) -> list[tuple]:
        return [(now["video"], now["first"], now["last"], now["n"], len(now["lines"]))]

    def step(now: dict, ts: int, lines: list[str]) -> list[tuple]:
        held, out = now.get("lines"), []
        if held is not None:
            n = next((k for k in range(min(len(held), len(lines)), 2, -1) if held[-k:] == lines[:k]), 0)
            if held == lines or n:
                lines = held + lines[n:] if n else lines
            elif difflib.SequenceMatcher(None, " ".join(held), " ".join(lines)).quick_ratio() >= least:
                lines = max(held, lines, key=lambda x: sum(map(len, x)))
            else:
                out, held = told(now), None
        if held is None:
            now |= {"first": ts, "n": 0}
        now |= {"lines": lines, "last": ts, "n": now["n"] + 1}
        return out

    def end(now: dict) -> list[tuple]:
        return step(now, now["at"], now["said"]) + told(now)

    return scan_sorted(rows.select("video", "ts", "seq", "said"), "video", ["ts", "seq"], "video long, first long, last long, n long, lines long", _moments(step), end)


def built_states(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """(video, state, first, last, words): moments join the newest state that shares enough words; thin readings stay pieces of it."""

    def step(now: dict, ts: int, lines: list[str]) -> list[tuple]:
        states = now.setdefault("states", [])
        words = {w for t in lines for w in t.lower().split()}
        hit = next((s for s in reversed(states) if words and len(words & s["words"]) >= share * min(len(words), len(s["words"]))), None)
        if hit is None:
            hit = {"state": len(states), "first": ts, "words": set()}
            states.append(hit)
        hit["words"] |= words
        hit["last"] = ts
        return []

    def end(now: dict) -> list[tuple]:
        step(now, now["at"], now["said"])
        return [(now["video"], s["state"], s["first"], s["last"], len(s["words"])) for s in now["states"]]

    return scan_sorted(rows.select("video", "ts", "seq", "said"), "video", ["ts", "seq"], "video long, state long, first long, last long, words long", _moments(step), end)
