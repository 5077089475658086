"""From scaffolds to sequences: trimming, overlaps, healing and gaps between neighbouring contigs.

A scaffold is a left fold over its contigs, so each is one group; nothing else
meets in a task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RC = str.maketrans("ACGTMRWSYKVHDBNacgtmrwsykvhdbn", "TGCAKYWSRMBDHVNtgcakywsrmbdhvn")
_CODING = re.compile("(?:(?!TAA|TAG|TGA)...)*")


def trim_ends(seq: str) -> str:
    """From the first ten unambiguous bases to the last ten; as it is if there are none."""
    first, last = (re.search("[ACGT]{10}", s) for s in (seq, seq[::-1]))
    return seq[first.start() : len(seq) - last.start()] if first and last else seq


def overlap(left: str, right: str, least: int = 6, slack: int = 0, most: int = 35) -> int:
    """The longest overlap of the left's end with the right's start, with at most ``2 * slack`` mismatches; 0 if none."""
    for n in range(min(most, len(left), len(right)), least - 1, -1):
        same = sum(a == b for a, b in zip(left[-n:].upper(), right[:n].upper(), strict=True))
        if same >= least and same >= n - 2 * slack:
            return n
    return 0


def heal(left: str, right: str, assembly: str, flank: int = 29, trim: int = 5, most: int = 500) -> str | None:
    """What another assembly has between the two contigs' ends, short of ``trim`` bases, on either strand."""
    a, b = left[len(left) - trim - flank : len(left) - trim], right[trim : trim + flank]
    if len(a) < flank or len(b) < flank:
        return None
    pattern = re.compile(re.escape(a) + "(.{1,%d}?)" % (most + 2 * trim) + re.escape(b), re.DOTALL)
    for text in (assembly, assembly.translate(_RC)[::-1]):
        if m := pattern.search(text):
            return m.group(1)
    return None


def _open(seq: str) -> list[int]:
    """For each frame, how far from the start of ``seq`` no stop codon comes."""
    return [_CODING.match(seq, f).end() - f for f in range(3)]


def frame_pad(left: str, right: str, window: int = 3000) -> int:
    """Bases, 0 to 2, that keep the longest reading frame open across the gap."""
    l, r = left[-window:].upper(), right[:window].upper()
    ahead = _open(r)
    behind = [_CODING.match(l[len(l) % 3 + f if f else len(l) % 3 :].translate(_RC)[::-1]).end() for f in range(3)]
    score = [(ahead[f] + behind[(3 - f) % 3], -f) for f in range(3)]
    return -max(score)[1]


def join_contigs(contigs: list[str], assembly: str = "", least: int = 6, slack: int = 0, most: int = 35, gap: int = 15) -> str:
    """One sequence of a scaffold's contigs: merged where they overlap (in lower case), healed, or with a gap of ``n``."""
    out = ""
    for seq in map(trim_ends, contigs):
        if not out:
            out = seq
        elif n := overlap(out, seq, least, slack, most):
            out = out[:-n] + out[-n:].lower() + seq[n:]
        elif assembly and (between := heal(out, seq, assembly)) is not None:
            out = out[:-5] + between.lower() + seq[5:]
        else:
            out += "n" * (gap + (frame_pad(out, seq) - gap) % 3) + seq
    return out


def lay_out(scaffolds: DataFrame, nodes: DataFrame, assembly: str = "", **options: int) -> DataFrame:
    """``scaffold_id, seq`` of scaffolds (``scaffold_id, nodes``) with their nodes' sequences; ``assembly`` heals gaps."""
    placed = scaffolds.select("scaffold_id", F.posexplode("nodes").alias("idx", "id")).join(nodes.select("id", "seq"), "id").select("scaffold_id", "idx", "seq")

    def run(rows):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = rows.sort_values("idx")
        return pd.DataFrame([(rows["scaffold_id"].iloc[0], join_contigs(rows["seq"].tolist(), assembly, **options))], columns=["scaffold_id", "seq"])

    return placed.groupBy("scaffold_id").applyInPandas(run, "scaffold_id string, seq string")
