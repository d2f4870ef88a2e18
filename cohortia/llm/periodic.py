"""Periodic runs of words, by the first phase of Baier's suffix sorter.

A run is a stretch of words with a smallest period that is repeated often enough and cannot be extended.
Grouping suffixes as that sorter's first phase does gives the longest Lyndon word at each place directly,
without the suffix array. By the runs theorem the first Lyndon root of every run is among these words,
under the order of words or its reverse; each root is extended to both sides as far as words one period
apart agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import BLANKS

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_array(ids: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place.

    Groups are processed from the highest down. Each member points to the nearest place before it that is
    in a lower group; a place that is pointed to so many times takes on so many copies of the group's word
    and moves to a new group just above its old one. A group's word is final when its turn comes.
    """
    n = len(ids)
    places: dict[int, list[int]] = {}
    for i, x in enumerate(ids):
        places.setdefault(x, []).append(i)
    # Group 0 closes the circle of groups, place n the circle of places not yet processed.
    members: list[list[int]] = [[], *(places[x] for x in sorted(places))]
    size = [len(m) for m in members]
    length = [1] * len(members)
    below = [len(members) - 1, *range(len(members) - 1)]
    above = [*range(1, len(members)), 0]
    group = [0] * (n + 1)
    for g, found in enumerate(members):
        for i in found:
            group[i] = g
    left, right = [n, *range(n)], [*range(1, n + 1), 0]
    out = [0] * n
    g = below[0]
    while g:
        c = length[g]
        # Those that moved on are still listed; places are listed in order, so none points to one of its own group.
        hits: dict[int, int] = {}
        for i in members[g]:
            if group[i] == g:
                out[i] = c
                p, r = left[i], right[i]
                right[p], left[r] = r, p
                hits[p] = hits.get(p, 0) + 1
        members[g] = []
        hits.pop(n, None)
        parts: dict[tuple[int, int], list[int]] = {}
        for p, times in hits.items():
            parts.setdefault((times, group[p]), []).append(p)
        for (times, old), moved in sorted(parts.items(), reverse=True) if len(parts) > 1 else parts.items():
            if size[old] == len(moved):
                length[old] += times * c
                continue
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            length.append(length[old] + times * c)
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = below[over] = new
            for p in moved:
                group[p] = new
        g = below[g]
    return out


def stretches(ids: np.ndarray, power: int, least: int) -> list[tuple[int, int]]:
    """Stretches of words outside of which no run can be.

    In a run of period q and length max(least, power * q) or more, any `width` words in a row come again q
    words to the left or right, inside the run. So a place counts only if its words come again at a
    distance of at most 1 / power of the stretch of such places that it lies in.
    """
    width = min(max(least, power * q) - 2 * q for q in range(1, least + 1))
    n = len(ids)
    if width < 1 or n < least:
        return [(0, n)] if n >= least else []
    with np.errstate(over="ignore"):
        # Equal numbers for different words only make stretches longer.
        mixed = ids[: n - width + 1].astype(np.uint64)
        for k in range(1, width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - width + 1 + k].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    gap = np.where(mixed[order[1:]] == mixed[order[:-1]], np.diff(order), n)
    near = np.empty(len(mixed), np.int64)
    near[order] = np.minimum(np.append(gap, n), np.append(n, gap))
    on = near < n
    for again in range(9):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + width - 1
        words = np.repeat(ends - starts, edges[1::2] - starts)
        at = np.flatnonzero(on)
        gone = at[(words < least) | (near[at] * power > words)]
        # Further rounds would only make the stretches shorter.
        if again == 8 or not len(gone):
            break
        on[gone] = False
    return list(zip(starts.tolist(), ends.tolist()))


def _agree(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from places a and b on, going right (step 1) or left (step -1)."""
    most = len(ids) - b if step > 0 else a + 1
    done, block = 0, 64
    while done < most:
        size = min(block, most - done)
        lo = (a + done, b + done) if step > 0 else (a - done - size + 1, b - done - size + 1)
        differ = np.flatnonzero(ids[lo[0] : lo[0] + size] != ids[lo[1] : lo[1] + size])
        if len(differ):
            return done + int(differ[0] if step > 0 else size - 1 - differ[-1])
        done, block = done + size, block * 2
    return done


def runs_of(ids: np.ndarray, power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of length max(least, power * period) or more, in this order."""
    found: set[tuple[int, int, int]] = set()
    for lo, hi in stretches(ids, power, least):
        words = ids[lo:hi]
        for ordered in (words, -words):
            p = np.array(lyndon_array(ordered.tolist()), np.int64)
            i = np.flatnonzero(np.arange(hi - lo) + (power - 1) * p < hi - lo)
            # The first root in a run is followed by power - 2 others at least: its first word comes again, the others' last as well.
            i = i[words[i] == words[i + p[i]]]
            for k in range(1, power - 1):
                i = i[words[i + k * p[i] - 1] == words[i + (k + 1) * p[i] - 1]]
            until: dict[int, int] = {}
            for at, q in zip((i + lo).tolist(), p[i].tolist()):
                if at + q <= until.get(q, 0):
                    continue  # A root inside a run of its period belongs to that run.
                start = at - _agree(ids, at - 1, at + q - 1, -1)
                end = at + q + _agree(ids, at, at + q, 1)
                until[q] = end
                if end - start >= max(least, power * q):
                    found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, power: int = 4, least: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed.

    collapsed holds the words left, joined by one space, when every run keeps its first period only. Words
    are parted by ASCII blanks; null and empty texts have no words, no runs and an empty collapsed text.
    Whole texts are read, whatever their length; a text lies in one task. Repeated rows give repeated
    rows, null ids stay null, an empty table gives an empty result, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                words = (t.as_py() or b"").split()  # of bytes, so by ASCII blanks only
                known = {w: k for k, w in enumerate(dict.fromkeys(words))}
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                found = runs_of(ids, power, least)
                if found:
                    keep = np.ones(len(words), bool)
                    for start, length, period in found:
                        keep[start + period : start + length] = False
                    texts.append(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]))
                else:
                    texts.append(b" ".join(words))
                counts.append(len(words))
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RUNS)


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text in which, for one document in ten, the words from some place on repeat the first of them periodically.

    With h the crc32 of the id, g = h div 10 and n words: if h % 10 = 0, the words from a = g % n on are the
    first 1 + (n - a) div (3 + g % 8) of them again and again. Other texts, those of no words and those of
    null ids stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.split(F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", ""), BLANKS)

    # Evaluated once for a row: the words and their number in a struct of one element.
    def changed(s: Column) -> Column:
        n = F.size(s["words"]).cast("long")
        a = F.floor(h / 10) % n
        rest = n - a
        period = 1 + F.floor(rest / (3 + F.floor(h / 10) % 8))
        tail = F.slice(s["words"], (a + 1).cast("int"), period.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(tail, F.ceil(rest / period).cast("int"))), F.lit(1), rest.cast("int"))
        return F.array_join(F.concat(F.slice(s["words"], F.lit(1), a.cast("int")), tail), " ")

    planted = F.transform(F.array(F.struct(words.alias("words"))), changed)[0]
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), planted).otherwise(text)
