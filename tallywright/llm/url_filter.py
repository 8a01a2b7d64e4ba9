"""URL filter: rules first, then logistic regression on hashed character n-grams.

The model sees host and path apart: every n-gram of ``^host$`` and ``^path$`` is
hashed, with a prefix that says which of the two it is from, to one of
``2**bits`` weights.  It is trained on the driver from a small labelled table
(``max_labelled`` rows at most, an error beyond), in full-batch steps, so the
same table gives the same weights.  Rules are looked up by walking a host's
suffixes in a dictionary, so their number hardly matters to a row's cost.

Nothing is shuffled: each row is judged where it is read.

Defined results: a null URL, or one without ``://``, has an empty host and path
and is judged by the model from its bias and the empty parts; very long URLs are
read in full; repeated rows are each judged; other columns pass through, and
``host``, ``path``, ``rule``, ``verdict`` and ``score`` replace columns of that name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import fresh, table

#: (rule, verdict): a host, a slash and how the path goes on.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

#: Words of junk and of other hosts, and what goes with them; the default labelled table is made of them.
JUNK = ("casino", "poker", "slots", "jackpot", "bets", "pills", "pharma", "loans", "spam", "clicks", "adult", "webcam", "ads", "popup", "replica", "coupons")
JUNK_TAILS = ("online", "best", "zone", "deals", "now", "world")
CLEAN = (
    "library", "garden", "history", "weather", "kitchen", "school", "museum", "science", "news", "city", "music", "travel", "recipes", "health", "nature", "river", "theatre", "letters",
    "maths", "archive", "hiking", "birds", "poetry", "trains", "ceramics", "village", "harbour", "physics", "cinema", "bakery", "forest", "chess",
)
CLEAN_TAILS = ("notes", "club", "house", "weekly")
SYLLABLES = ("lor", "mis", "tan", "quel", "bre", "dov", "ren", "sil")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, blocked): hosts made of the words above, with subdomains, endings and paths that say nothing."""
    junk = [f"{w}-{t}" if n % 2 else f"{t}-{w}" for n, w in enumerate(JUNK) for t in JUNK_TAILS]
    clean = [f"{w}-{t}" if n % 2 else f"{t}-{w}" for n, w in enumerate(CLEAN) for t in CLEAN_TAILS] + list(CLEAN)
    clean += [a + b + c for a in SYLLABLES for b in SYLLABLES[::3] for c in SYLLABLES[1::3]]
    out = []
    for n, (name, blocked) in enumerate([(x, 1) for x in junk] + [(x, 0) for x in clean]):
        sub, end = ("", "www.", "m.", "blog.")[n % 4], (".com", ".org", ".net", ".info")[n // 3 % 4]
        path = (f"/en/{n * 7}", f"/de/{n}.html", f"/fr/{n}?page=2", f"/es/{n * 3}/#top", "/")[n % 5]
        out.append((f"{'https' if n % 2 else 'http'}://{sub}{name}{end}{path}", blocked))
    return out


MAX_LABELLED = 10_000


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; A-Z of the host are lower-cased."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


class Rules:
    """Longest rule for a host and path; of equal length, the first given."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))

    def fit(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        suffix = host
        while suffix:
            for start, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            suffix = suffix.partition(".")[2]
        return best


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int
    sizes: tuple[int, ...]

    def slots(self, host: str, path: str) -> list[int]:
        mask = (1 << self.bits) - 1
        out = []
        for kind, part in (("h", host), ("p", path)):
            marked = f"^{part}$"
            for n in self.sizes:
                out += [zlib.crc32((kind + marked[i : i + n]).encode("utf-8", "surrogatepass")) & mask for i in range(len(marked) - n + 1)]
        return out

    def score(self, host: str, path: str) -> float:
        slots = self.slots(host, path)
        z = self.bias + float(self.weights[slots].sum()) / max(1.0, len(slots) ** 0.5)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(
    labelled: Sequence[tuple[str | None, int]] | None = None, bits: int = 16, sizes: tuple[int, ...] = (3, 4, 5),
    steps: int = 300, rate: float = 1.0, l2: float = 1e-3, max_labelled: int = MAX_LABELLED,
) -> UrlModel:
    """Full-batch gradient descent on (url, blocked), by default ``labelled_urls``; a table of one class or none gives that class or 0.5."""
    labelled = labelled_urls() if labelled is None else labelled
    rows = [(u, y) for u, y in labelled if y is not None]
    if len(rows) > max_labelled:
        raise ValueError(f"the labelled table has over {max_labelled} rows")
    blank = UrlModel(np.zeros(1 << bits), 0.0, bits, tuple(sizes))
    if not rows:
        return blank
    y = np.array([float(b) for _, b in rows])
    slots = [np.array(blank.slots(*parts(u)), dtype=np.int64) for u, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
    col = np.concatenate(slots)
    value = 1 / np.sqrt(np.array([max(1, len(s)) for s in slots], dtype=float))[row]
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        z = b + np.bincount(row, w[col] * value, minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w -= rate * (np.bincount(col, error[row] * value, minlength=len(w)) / len(rows) * 8 + l2 * w)
        b -= rate * error.mean()
    return UrlModel(w, float(b), bits, tuple(sizes))


def judge(
    pages: DataFrame, url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES,
    model: UrlModel | None = None, threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and the model's score; only URLs go to Python."""
    found, model = Rules(rules), model or train()
    added = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")] + [T.StructField("score", T.DoubleType())])

    @F.arrow_udf(added)
    def judged(urls: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in added.names]
        for i in range(len(urls)):
            host, path = parts(urls[i].as_py())
            rule, verdict = found.fit(host, path)
            score = model.score(host, path)
            for column, value in zip(out, (host, path, rule, verdict or ("block" if score >= threshold else "allow"), score)):
                column.append(value)
        kinds = [pa.string()] * 4 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], added.names)

    (name,) = fresh(pages.columns, "judged")
    kept = [c for c in pages.columns if c not in added.names]
    rows = pages.withColumn(name, judged(pages[url_col].cast("string")))
    return rows.select(*kept, *[F.col(name)[n].alias(n) for n in added.names])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
