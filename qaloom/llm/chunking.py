"""Problem 6: pieces within a limit, cut at natural boundaries that the content itself picks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.common import strip
from qaloom.operators.rows import latest_rows
from qaloom.sources.tables import table

#: Kinds of boundary, best first, as the position after which a piece may end.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("sentence", re.compile(r"(?<=[.!?…。！？])[\"'”’)\]]*\s+(?=[\"'“‘(\[]*[\w])")),
    ("line", re.compile(r"\n")),
    ("word", re.compile(r"\s+")),
)


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in code points. A piece has at most `limit`, of which `overlap` at most repeat the end of the last piece."""

    limit: int = 2000
    least: int = 600
    overlap: int = 200
    window: int = 32
    mask: int = 255
    reach: int = 300


def landmarks(text: str, window: int, mask: int) -> np.ndarray:
    """Positions after which the rolling hash of the last `window` code points has its low bits zero."""
    if len(text) < window:
        return np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - window + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64(mask)) == 0) + window


def cut_points(text: str, cfg: ChunkConfig) -> list[tuple[int, str]]:
    """Ends of the pieces with the kind of boundary of each; the last is the text's end.

    Between the least size and the limit the first landmark is taken and moved to the nearest boundary, the best kind
    that lies within `reach` of it. Without a landmark the last boundary of the best kind in the second half of the
    window serves, and only a text without any boundary is cut at the limit. Landmark and boundary depend on the text
    near them alone, so an edit moves only the cuts around it.
    """
    room = cfg.limit - cfg.overlap
    if len(text) <= cfg.limit:
        return [(len(text), "end")]
    marks = landmarks(text, cfg.window, cfg.mask)
    ends = {kind: np.array([m.end() for m in rx.finditer(text)], dtype=np.int64) for kind, rx in BOUNDARIES}
    cuts: list[tuple[int, str]] = []
    start = 0
    while len(text) - start > room:
        low, high = start + min(cfg.least, room - 1), start + room
        at = marks[np.searchsorted(marks, low) :]
        at = int(at[0]) if len(at) and at[0] <= high else None
        cut = None
        for kind, pos in ends.items():
            near = pos[np.searchsorted(pos, low) : np.searchsorted(pos, high, "right")]
            if not len(near):
                continue
            if at is not None:
                best = int(near[np.argmin(np.abs(near - at))])
                if abs(best - at) <= cfg.reach:
                    cut = (best, kind)
                    break
            elif int(near[-1]) - start >= room // 2:
                cut = (int(near[-1]), kind)
                break
        if cut is None:  # the nearest boundary of any kind, else none
            near = [(int(p), kind) for kind, pos in ends.items() for p in pos[np.searchsorted(pos, low) : np.searchsorted(pos, high, "right")][-1:]]
            cut = max(near, default=(high, "none"))
        cuts.append(cut)
        start = cut[0]
    return [*cuts, (len(text), "end")]


def pieces(text: str, cfg: ChunkConfig) -> list[tuple[int, int, int, str]]:
    """(start, own start, end, boundary) of each piece; from start to own start it repeats the piece before.

    The repeated part begins at the first word that starts within `overlap` of the cut, or exactly there in a text
    without white space.
    """
    out, own = [], 0
    for end, kind in cut_points(text, cfg):
        start = own
        if own:
            start = max(0, own - cfg.overlap)
            m = re.compile(r"(?<=\s)\S").search(text, max(start, 1), own)
            if m and start and not text[start - 1].isspace():
                start = m.start()
        out.append((start, own, end, kind))
        own = end
    return out


def chunk(items: DataFrame, item_id: Column, text: Column, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """`id`, `piece` from 0, `pieces`, `start`, `own_start`, `end`, `boundary` and `text` of every piece of every item.

    White space at both ends doesn't count and is left off, offsets are in the text without it. A text within the limit
    is one piece; null, empty and blank texts have none. Repeated ids give their pieces twice. No shuffle: each row is
    cut where it is read. Other columns are not read.
    """
    schema = "id string, piece int, pieces int, start int, own_start int, end int, boundary string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, body in zip(pdf["id"], pdf["text"], strict=True):
                body = body.strip()
                if not body:
                    continue
                parts = pieces(body, cfg)
                rows += [(key, k, len(parts), s, o, e, kind, body[s:e]) for k, (s, o, e, kind) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["id", "piece", "pieces", "start", "own_start", "end", "boundary", "text"])

    return items.select(item_id.cast("string").alias("id"), text.alias("text")).where(F.col("text").isNotNull()).mapInPandas(run, schema)


def _oversized(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """The latest delivery of each record, if its context may exceed the limit.

    A stripped text is no longer than the text, so the length alone is sent first and the long texts only after.
    """
    rows = table(spark, sf_dir, "qa_raw").select("id", "loaded_at", "context", F.length(strip(F.col("context"))).alias("n"))
    last = latest_rows(rows.select("id", "loaded_at", F.when(F.col("n") > limit, F.col("context")).alias("context")), "id", "loaded_at", ["id", "context"])
    return last.where(F.col("context").isNotNull())


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces within 2,000 characters of the contexts of qa_raw beyond that."""
    cfg = ChunkConfig()
    return chunk(_oversized(spark, sf_dir, cfg.limit), F.col("id"), F.col("context"), cfg)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose context has to be cut: those that come out in more than one piece."""
    return p6_pieces(spark, sf_dir).where((F.col("piece") == 0) & (F.col("pieces") > 1)).select("id")


P6_FOUND_SQL = r"""
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS d FROM qa_raw WHERE id IS NOT NULL
)
SELECT id FROM latest WHERE d = 1 AND length(regexp_replace(context, '^[\s\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\p{Z}]+|[\s\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\p{Z}]+$', '', 'g')) > 2000
"""
