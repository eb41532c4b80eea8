"""The figures of the README on the R-tree of problem 6: python tests/llm/rtree_figures.py SF_DIR.

For each number of groups: the share of random pairs (sizes within the threshold) that
survive the summed-minima bound, and the share of pairs of leaves (32 texts each, packed
by sort-tile order of their two widest coordinates) that survive on their boxes.
"""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from filingloom.operators.similarity import group_counts, sets_of  # noqa: E402

THRESHOLD, LEAF, PAIRS = 0.7, 32, 20_000


def main(folder: str) -> None:
    texts = pq.read_table(f"{folder}/records.parquet", columns=["text"]).column("text").combine_chunks().drop_null()
    texts = texts.filter(np.array([len(t.as_py()) >= 200 for t in texts])).unique()
    sets = sets_of(texts, 3)
    size = np.array([len(s) for s in sets])
    rng = np.random.default_rng(0)
    print(f"{len(sets)} texts, mean {size.mean():.0f} shingles")
    for groups in (16, 32, 64, 128, 256):
        points = np.stack([group_counts(s, groups) for s in sets])
        a, b = rng.integers(0, len(sets), (2, PAIRS))
        near = np.minimum(size[a], size[b]) >= THRESHOLD * np.maximum(size[a], size[b])
        a, b = a[near], b[near]
        need = THRESHOLD / (1 + THRESHOLD)
        survive = np.minimum(points[a], points[b]).sum(1) >= need * (size[a] + size[b])
        wide = np.argsort(-points.var(0))[:2]
        order = np.lexsort((points[:, wide[1]], points[:, wide[0]] // max(1, int(points[:, wide[0]].std()))))
        leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        high = np.stack([points[x].max(0) for x in leaves])
        least = np.array([size[x].min() for x in leaves])
        i, j = rng.integers(0, len(leaves), (2, PAIRS))
        boxes = np.minimum(high[i], high[j]).sum(1) >= need * (least[i] + least[j])
        print(f"{groups:4d} groups: {100 * survive.mean():.2f} % of pairs, {100 * boxes.mean():.1f} % of leaf pairs")


if __name__ == "__main__":
    main(sys.argv[1])
