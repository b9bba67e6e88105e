"""A slow sequential model of the detectors, written from the rules, for comparison only."""

from __future__ import annotations

import math
from itertools import pairwise


def nm(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 3440.065 * math.asin(math.sqrt(min(1.0, h)))


def rnd(x, n):
    return round(x, n)


def tracks(pings):
    out = {}
    for p in sorted(pings, key=lambda p: (p["mmsi"], p["ts"], p["seq"])):
        out.setdefault(p["mmsi"], []).append(p)
    return out


def going_dark(track):
    for a, b in pairwise(track):
        h, d = (b["ts"] - a["ts"]) / 3600.0, nm(a, b)
        if h >= 4.0 and (d >= 1.0 or d / h >= 0.1):
            yield b["mmsi"], rnd(h, 2), rnd(d, 2), a["ts"], b["ts"]


def draught_change(track):
    for a, b in pairwise(track):
        x, y, h = a["draught"], b["draught"], (b["ts"] - a["ts"]) / 3600.0
        if x >= 0.5 and y >= 0.5 and h >= 2.0 and abs(y - x) / x >= 0.05:
            yield b["mmsi"], rnd(h, 2), x, y, a["ts"], b["ts"]


def cloning(track):
    run = []

    def widest():
        best = None
        for a, b in run:
            if best is None or nm(a, b) > rnd(nm(*best), 2):
                best = a, b
        run.clear()
        return [("speed_violation", best[0]["mmsi"], rnd(nm(*best), 2), best[0]["ts"], best[1]["ts"])] if best else []

    for a, b in pairwise(track):
        if a["ts"] == b["ts"]:
            if (a["lat"], a["lon"]) != (b["lat"], b["lon"]) and nm(a, b) >= 0.5:
                yield "simultaneous_transmission", a["mmsi"], rnd(nm(a, b), 2), a["ts"], b["ts"]
        elif nm(a, b) / ((b["ts"] - a["ts"]) / 3600.0) >= 60.0:
            run.append((a, b))
        else:
            yield from widest()
    yield from widest()


def candidates(track):
    run = []

    def ended(fast):
        slow = list(run)
        run.clear()
        if len(slow) < 2:
            return
        start, end = slow[0]["ts"], slow[-1]["ts"]
        if end - start < 7200:
            if fast is None or fast["ts"] - start < 7200:
                return
            end = fast["ts"]
        known = [p["draught"] for p in slow if p["draught"] >= 0.5]
        yield {
            "mmsi": slow[0]["mmsi"], "ts_start": start, "ts_end": end, "lat": sum(p["lat"] for p in slow) / len(slow), "lon": sum(p["lon"] for p in slow) / len(slow),
            "first": known[0] if known else None, "last": known[-1] if known else None,
        }

    for p in track:
        if p["sog"] < 1.0:
            run.append(p)
        else:
            yield from ended(p)
    yield from ended(None)


def loitering(cands):
    best = {}
    cands = sorted(cands, key=lambda c: (c["ts_start"], c["mmsi"] % 64, c["mmsi"]))
    for i, a in enumerate(cands):
        for b in cands[i + 1 :]:
            start, end = max(a["ts_start"], b["ts_start"]), min(a["ts_end"], b["ts_end"])
            if a["mmsi"] == b["mmsi"] or end - start < 7200:
                continue
            d = nm(a, b) * 1852.0
            key = frozenset((a["mmsi"], b["mmsi"]))
            if d <= 500.0 and (key not in best or d < best[key][2]):
                best[key] = a["mmsi"], b["mmsi"], rnd(d, 1), start, end
    return sorted(best.values())
