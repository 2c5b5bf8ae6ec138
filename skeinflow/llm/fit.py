"""Fits the weights of the main-body classifier: ``python -m skeinflow.llm.fit FOLDER [PAGES]``.

There are no labelled rows, so the names of containers label lines: in pages with a container named as the body (main,
article, content ...), its lines are content and all others are not.  The classifier doesn't read those names, so it can
be used where there are none.  A line inside that repeats over the collection may be an advertisement or a byline, and is
left out of the fit, but for code, table cells and the title.  In pages with markup the lines that the cut keeps then label
a second fit, as the cut sees containers and text; for pages without markup the features that only markup has are left out.

The fit reads at most PAGES pages (those of the least hashed page_id), and the counts of repeated pieces of their own.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

from skeinflow.llm import boilerplate as B
from skeinflow.llm.frames import Counts, repetition

#: Most pages of a fit; least repetition of a line that is left out; weight of the penalty; what the weights are times, so
#: that they outweigh the edges of the cut.
PAGES, UNSURE, PENALTY, SCALE = 6000, 0.3, 2.0, 2.0
_MARKUP_ONLY = ["block", "cell", "linked", "teaser", "before_repeated", "after_repeated", "around_frame"]
_AT = {f: k for k, f in enumerate(B.FEATURES)}


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of least penalised logistic loss, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), x.T @ (p - y) + PENALTY * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _rows(parsed: list[tuple[B.Lines, np.ndarray]], labels: list[list[bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the lines that are sure."""
    x = np.concatenate([m for _, m in parsed])
    y = np.array([k for keep in labels for k in keep], bool)
    repeats = x[:, [_AT["repeated"], _AT["first_repeated"]]].max(axis=1) > UNSURE
    unsure = y & repeats & (x[:, [_AT["code"], _AT["cell"], _AT["title"]]].max(axis=1) == 0)
    return x[~unsure], y[~unsure].astype(float)


def _by_container(lines: B.Lines) -> list[bool]:
    out = []
    for inside, hint in zip(lines.inside, lines.hint, strict=True):
        names = [lines.hints[c] for c in B._chain(lines.parents, inside)]
        out.append(any(n > 0 for n in names) and all(n >= 0 for n in [*names, hint]))
    return out


def fit(pages: list[str], urls: list[str | None], counts: Counts | None = None) -> dict[bool, list[float]]:
    """Weights for pages with markup and without; ``counts`` are those of the pages where none are given."""
    if counts is None:
        each = dict(zip(pages, urls, strict=True))
        counts = Counts.of(list(each), list(each.values()))
    parsed = []
    for page, url, repeated in zip(pages, urls, repetition(pa.array(pages, pa.string()), pa.array(urls, pa.string()), counts), strict=True):
        lines = B.Lines(page, url)
        if lines.markup and lines.text:
            parsed.append((lines, lines.matrix(repeated)))
    named = [p for p in parsed if any(h > 0 for h in p[0].hints)]
    x, y = _rows(named, [_by_container(lines) for lines, _ in named])
    first = logistic(x, y) * SCALE
    plain = x.copy()
    plain[:, [_AT[f] for f in _MARKUP_ONLY]] = 0
    without = logistic(plain, y) * SCALE
    kept = []
    for lines, m in parsed:
        lines.unary = (m @ first + np.array(lines.hint)).tolist()
        kept.append(B.label(lines))
    again = logistic(*_rows(parsed, kept)) * SCALE
    return {True: again.round(2).tolist(), False: without.round(2).tolist()}


def main() -> None:
    import pandas as pd

    crawl = pd.read_parquet(f"{sys.argv[1]}/crawl.parquet", columns=["page_id", "page", "url"])
    crawl = crawl[crawl.page.fillna("").str.strip() != ""].drop_duplicates("page_id")
    least = pd.util.hash_array(crawl.page_id.to_numpy()).argsort()[: int(sys.argv[2]) if len(sys.argv) > 2 else PAGES]
    sample = crawl.iloc[least]
    for markup, weights in fit(sample.page.tolist(), sample.url.tolist()).items():
        print(markup, dict(zip(B.FEATURES, weights, strict=True)))


if __name__ == "__main__":
    main()
