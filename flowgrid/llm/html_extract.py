"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.llm.bpe import slices
from flowgrid.llm.html_blocks import Block, leaf_blocks
from flowgrid.llm.html_pages import labelled_pages

#: Labelled pages and passes over them: they bound the training.
PAGES = 1000
PASSES = 8

# Words that mark parts other than the main text.
_SIGNS = {
    "rights": ("©", "copyright", "rights reserved"),
    "cookie": ("cookie", "consent", "privacy"),
    "advert": ("advertisement", "sponsored", "anzeige", "publicité"),
    "form": ("subscribe", "newsletter", "sign up", "log in", "your email"),
    "reply": ("reply", "comments", "says:", "posted by"),
}


def _bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def path_features(path: tuple[str, ...]) -> list[str]:
    """Features of a block's ancestors: every tag and name, and the nearest tags in order."""
    tags = [s.split(" ", 1)[0] for s in path]
    out = {f"in:{t}" for t in tags} | {f"name:{n}" for s in path for n in s.split()[1:]}
    out |= {f"last:{tags[-1]}" if tags else "last:", f"last2:{'/'.join(tags[-2:])}", f"depth:{min(len(tags), 6)}"}
    return sorted(out)


def text_features(block: Block, title: str, place: int, last: int) -> list[str]:
    text = block.text
    low, words = text.lower(), text.count(" ") + 1
    out = ["bias", f"words:{_bucket(words, (2, 4, 8, 16, 32, 64, 128))}", f"links:{_bucket(block.link_chars / len(text), (0.01, 0.3, 0.7))}", f"stop:{text[-1] in '.!?…\"”»'}"]
    if place == 0:
        out.append("first")
    if place == last:
        out.append("end")
    if title and len(text) >= 4 and (title.startswith(text) or text.startswith(title)):
        out.append("title")
    for k, signs in _SIGNS.items():
        if hits := sum(low.count(s) for s in signs):
            # By how much of the text they are: an article may speak of cookies, a notice hardly of else.
            share = 100 * hits / words
            out.append(f"sign:{k}" if share >= 2 else f"rare:{k}")
            if words >= 32:
                out.append(f"long:{k}:{_bucket(share, (1, 2, 5))}")
    return out


class BlockCrf:
    """Two labels, 1 for main text. ``weights`` score label 1 against 0; ``step`` scores pairs."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]
        self._paths: dict[tuple[str, ...], float] = {}

    def _scores(self, title: str, blocks: list[Block]) -> list[float]:
        out, get = [], self.weights.get
        for k, b in enumerate(blocks):
            of_path = self._paths.get(b.path)
            if of_path is None:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                of_path = self._paths[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            out.append(of_path + sum([get(f, 0.0) for f in text_features(b, title, k, len(blocks) - 1)]))
        return out

    def decode(self, title: str, blocks: list[Block]) -> list[int]:
        """The labels of greatest joint score, by Viterbi."""
        if not blocks:
            return []
        scores, back = self._scores(title, blocks), []
        best = [0.0, scores[0]]
        for s in scores[1:]:
            from0 = 0 if best[0] + self.step[0][0] >= best[1] + self.step[1][0] else 1
            from1 = 0 if best[0] + self.step[0][1] >= best[1] + self.step[1][1] else 1
            best = [best[from0] + self.step[from0][0], best[from1] + self.step[from1][1] + s]
            back.append((from0, from1))
        labels = [int(best[1] > best[0])]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]

    def fit(self, pages: list[tuple[str, str]], passes: int = PASSES, rate: float = 0.3, decay: float = 1e-5) -> BlockCrf:
        """Maximum likelihood by AdaGrad over the pages in turn; weights shrink a little."""
        data = []
        for page, main in pages:
            title, blocks = leaf_blocks(page)
            wanted = Counter(main.split("\n"))
            labels = []
            for b in blocks:
                labels.append(int(wanted[b.text] > 0))
                wanted[b.text] -= labels[-1]
            data.append(([path_features(b.path) + text_features(b, title, k, len(blocks) - 1) for k, b in enumerate(blocks)], labels))
        w, seen = self.weights, Counter()
        step, step_seen = self.step, [[1e-6, 1e-6], [1e-6, 1e-6]]
        for _ in range(passes):
            for features, labels in data:
                if not labels:
                    continue
                single, pair = self._marginals([sum(w.get(f, 0.0) for f in fs) for fs in features])
                for fs, y, p in zip(features, labels, single, strict=True):
                    g = y - p
                    for f in fs:
                        seen[f] += g * g
                        w[f] = w.get(f, 0.0) * (1 - decay) + rate * g / math.sqrt(1e-6 + seen[f])
                for a in (0, 1):
                    for b in (0, 1):
                        g = sum(x == a and y == b for x, y in zip(labels, labels[1:], strict=False)) - pair[a][b]
                        step_seen[a][b] += g * g
                        step[a][b] += rate * g / math.sqrt(step_seen[a][b])
        self._paths.clear()
        return self

    def _marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Probability of label 1 at each block, and expected counts of pairs (forward-backward)."""
        e = [[math.exp(x) for x in row] for row in self.step]
        n = len(scores)
        potential = [math.exp(max(-30.0, min(30.0, s))) for s in scores]
        ahead = [(1.0 / (1.0 + potential[0]), potential[0] / (1.0 + potential[0]))]
        for u in potential[1:]:
            a0 = ahead[-1][0] * e[0][0] + ahead[-1][1] * e[1][0]
            a1 = (ahead[-1][0] * e[0][1] + ahead[-1][1] * e[1][1]) * u
            ahead.append((a0 / (a0 + a1), a1 / (a0 + a1)))
        single, pair, b0, b1 = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]], 1.0, 1.0
        for k in range(n - 1, -1, -1):
            f0, f1 = ahead[k]
            single[k] = f1 * b1 / (f0 * b0 + f1 * b1)
            if k:
                g0, g1, u = ahead[k - 1][0], ahead[k - 1][1], potential[k]
                x = ((g0 * e[0][0] * b0, g0 * e[0][1] * u * b1), (g1 * e[1][0] * b0, g1 * e[1][1] * u * b1))
                total = x[0][0] + x[0][1] + x[1][0] + x[1][1]
                for a in (0, 1):
                    for b in (0, 1):
                        pair[a][b] += x[a][b] / total
                b0, b1 = e[0][0] * b0 + e[0][1] * u * b1, e[1][0] * b0 + e[1][1] * u * b1
                b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
        return single, pair

    def main_text(self, page: str) -> str:
        title, blocks = leaf_blocks(page)
        return "\n".join([b.text for b, y in zip(blocks, self.decode(title, blocks), strict=True) if y])


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, passes: int = PASSES) -> BlockCrf:
    """The extractor trained on so many labelled pages."""
    return BlockCrf().fit(labelled_pages(pages), passes)


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: BlockCrf | None = None) -> DataFrame:
    """Main text of every whole page: the columns ``keep``, ``text`` and ``n_chars`` (code points).

    A null or empty page has an empty text. Pages don't influence each other; the model, whose size
    its training bounds, goes to the tasks with their code.
    """
    crf = model or trained()
    schema = T.StructType([*[pages.schema[k] for k in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch):
                texts = [crf.main_text(p.as_py() or "") for p in small.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*[small.column(k) for k in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, F.col(html).cast("string").alias("_html_in")).mapInArrow(run, schema)
