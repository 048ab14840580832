"""Secret scans: fixed patterns, and a character convolutional network over every candidate string.

One pass over the whole texts finds the base spans and the other candidates (long runs of token
characters with a letter and a digit) with their surroundings; a second pass over that small table
scores them. The network (embedding, one convolution, largest response inside and outside the candidate,
logistic output) is plain numpy. It is trained on labelled findings: all of the corpus' base
findings (secrets) and all of its candidates that are words and short numbers joined by signs (plain), and made-up
secrets and plain identifiers in borrowed surroundings, so that the string itself must decide. Of an assignment
the value is the candidate and its word stands before it, as in what is scored. Other candidates have no label:
the base patterns miss secrets, so nothing is learnt from their silence. A value lies in one of three parts by its
hash: the first is fitted; the second calibrates the output and sets the highest threshold that still finds
LEAST_RECALL of every family of secrets, found or made up; recall and precision are those of the third. A candidate longer than the window is read by windows that overlap by half; the largest response counts.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The base kinds in their order. Letters of the words count in either case.
KINDS = ("assign", "access", "hex", "cnn")
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_CASED = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = re.compile(rf"""(?:{_CASED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Words and short numbers joined by signs, as file names, addresses and versions are.
_PLAIN = re.compile(r"(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,4}|[A-Za-z]?[a-z]*[0-9]{1,3})(?:[+/_.=-]+(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,4}|[A-Za-z]?[a-z]*[0-9]{1,3}))*")
_UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A run without a digit is a candidate if it holds so many letters in a row, with a capital behind a small one among them.
_LETTERS, _MIXED = re.compile("[A-Za-z]{16,}"), re.compile("[a-z][A-Z]")
LEAST = {"assign": 6, "access": 20}

_HEX_RUN = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")

#: Characters of the window: before, of and after the candidate.
BEFORE, INSIDE, AFTER = 24, 48, 12
LENGTH = BEFORE + INSIDE + AFTER
_SYMBOLS = string.ascii_letters + string.digits + "+/_.=-:\"'(){}[]<>@,;!? \n\t"
_CODE = {c: i + 2 for i, c in enumerate(_SYMBOLS)}  # 0: nothing there, 1: another character
LABELLED, MADE, CHECKED, STEPS, LEAST_RECALL, SEED = 3000, 6000, 2400, 400, 0.98, 5
#: Families of made-up strings, secret and plain.
SECRETS, PLAIN = ("hex", "base36", "upper", "base64", "prefixed", "letters"), ("joined", "host", "uuid", "camel", "date")
_PREFIXES = ("AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "eyJ")
_WORDLIST = ("version", "module", "chapter", "example", "mail", "www", "index", "report", "section", "build", "release", "file", "img", "page", "item", "user", "test", "data")
WIDTH, DIM, FILTERS = 5, 8, 24
#: Steps of a logit; passes over the rows that are fitted, at least.
CELLS, PASSES = 64, 8


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, per kind leftmost and without overlap."""
    raw, out = text.encode("utf-8", "surrogatepass"), []
    low = raw.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"1" * 24 in raw.translate(_HEX_RUN):
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Runs of token characters with a letter and a digit, or many letters of both cases, that no base span touches."""
    out, taken, at = [], sorted((s, e) for s, _, e in base), 0
    reach = 0  # the furthest end of the base spans that start before the run's end
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][0] < b:
            reach, at = max(reach, taken[at][1]), at + 1
        run = m[0]
        letters = any(c.isalpha() for c in run)
        if letters and reach <= a and (any(c.isdigit() for c in run) or any(_MIXED.search(x) for x in _LETTERS.findall(run))):
            out.append((a, b))
    return out


def value_start(text: str, start: int, kind: str) -> int:
    """Where the secret itself begins: of an assignment behind its word and signs."""
    return ASSIGN.match(text, start).start(1) if kind == "assign" else start


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate and its surroundings at fixed places, NUL where nothing is; of a long one every part, overlapping by half."""
    before, after = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0")
    own = text[start:end]
    steps = range(0, max(1, len(own) - INSIDE // 2), INSIDE // 2)
    return [before + own[at : at + INSIDE].ljust(INSIDE, "\0") + after for at in steps]


def encode(windows: list[str]) -> np.ndarray:
    out = np.empty((len(windows), LENGTH), np.uint8)
    for i, w in enumerate(windows):
        out[i] = [0 if c == "\0" else _CODE.get(c, 1) for c in w]
    return out


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    #: Of the third part at the threshold; the share found of each family of unseen made-up strings (of plain ones too).
    recall: float = 0.0
    precision: float = 0.0
    families: dict[str, float] = field(default_factory=dict)
    #: Distinct labelled findings of the corpus that it learnt from, made-up ones aside.
    findings: int = 0

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        x = np.zeros((len(codes), LENGTH + WIDTH - 1, DIM + 1), np.float32)
        x[:, WIDTH // 2 : -(WIDTH // 2), :DIM] = self.embed[codes]
        x[:, WIDTH // 2 + BEFORE : WIDTH // 2 + BEFORE + INSIDE, DIM] = 1
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), LENGTH, -1)

    def _pooled(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest responses inside, then outside, and their places."""
        inside = z[:, BEFORE : BEFORE + INSIDE].argmax(1) + BEFORE
        hidden = z.copy()
        hidden[:, BEFORE : BEFORE + INSIDE] = -1
        at = np.concatenate([inside, hidden.argmax(1)], 1)
        both = np.concatenate([z, z], 2)
        return np.take_along_axis(both, at[:, None, :], 1)[:, 0], at

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [codes[i : i + 256] for i in range(0, len(codes), 256)]
        found = [self._pooled(np.maximum(self._columns(c) @ self.conv + self.bias, 0))[0] @ self.out + self.shift[0] for c in parts]
        return np.concatenate(found) if found else np.empty(0)

    def cells(self, codes: np.ndarray) -> np.ndarray:
        """Logits in whole steps of 1 / CELLS, by which all rows are counted."""
        return np.floor(np.clip(self.logits(codes), -100, 100) * CELLS).astype(np.int64)

    def of_cells(self, cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * (cells / CELLS) + self.scale[1], -40, 40)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.of_cells(self.cells(codes))

    def gradients(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        n = len(codes)
        columns = self._columns(codes)
        z = np.maximum(columns @ self.conv + self.bias, 0)
        pooled, at = self._pooled(z)
        d = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift[0], -40, 40))) - labels) * weights / n
        dz = np.zeros((n, LENGTH, FILTERS), np.float32)
        back = (d[:, None] * self.out[None, :] * (pooled > 0)).astype(np.float32)
        i, f = np.meshgrid(np.arange(n), np.arange(2 * FILTERS), indexing="ij")
        np.add.at(dz, (i, at, f % FILTERS), back)
        flat = dz.reshape(-1, FILTERS)
        dx = (dz @ self.conv.T).reshape(n, LENGTH, WIDTH, DIM + 1)
        gathered = np.zeros((n, LENGTH, DIM))
        for k in range(WIDTH):
            lo, hi = max(0, k - WIDTH // 2), LENGTH + min(0, k - WIDTH // 2)
            gathered[:, lo:hi] += dx[:, lo - (k - WIDTH // 2) : hi - (k - WIDTH // 2), k, :DIM]
        flat_codes = codes.ravel()
        de = np.stack([np.bincount(flat_codes, gathered[:, :, d].ravel(), len(self.embed)) for d in range(DIM)], 1).astype(np.float32)
        return [de, columns.reshape(-1, columns.shape[2]).T @ flat, flat.sum(0), pooled.T @ d, np.array([d.sum()])]


def _part(window: str) -> int:
    """0 to 2: fitted, 3: calibrates, 4: reported; equal values share a part."""
    return zlib.crc32(window[BEFORE : BEFORE + INSIDE].encode("utf-8", "surrogatepass")) % 5


def _begun() -> Network:
    rng = np.random.default_rng(SEED)
    return Network(
        rng.normal(0, 0.3, (len(_SYMBOLS) + 2, DIM)).astype(np.float32),
        rng.normal(0, 0.15, (WIDTH * (DIM + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )


def _params(net: Network) -> list[np.ndarray]:
    return [net.embed, net.conv, net.bias, net.out, net.shift]


def _passed(state: tuple[list, list, list], t: int, codes: np.ndarray, y: np.ndarray, share: float, passes: int, seed: list[int]) -> tuple[tuple[list, list, list], int]:
    """Parameters and their two moments after `passes` passes of Adam over the rows, and the steps done; `share`: of secrets in all rows."""
    params, first, second = ([x.copy() for x in xs] for xs in state)
    net, rng = Network(*params), np.random.default_rng(seed)
    weights = np.where(y == 1, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))
    for _ in range(passes):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 128):
            pick, t = order[at : at + 128], t + 1
            for p, g, m, v in zip(params, net.gradients(codes[pick], y[pick], weights[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (0.004 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(p.dtype)
    return (params, first, second), t


def _settle(net: Network, counts: list[tuple[int, int, str | None, int, int]]) -> None:
    """Calibration and threshold from the second part, report from the third; `counts`: (part, label, family or None, cell, rows) of all rows."""
    table = np.array([(p, y, c, n) for p, y, f, c, n in counts if f is None], np.int64).reshape(-1, 4)
    held, last = table[table[:, 0] == 3], table[table[:, 0] == 4]
    net.scale = _calibrated(held[:, 2] / CELLS, held[:, 1].astype(np.float64), held[:, 3])
    of = lambda part, family: np.array([(c, n) for p, _, f, c, n in counts if p == part and f == family], np.int64).reshape(-1, 2)
    lost = lambda n: max(0.0, 1 - LEAST_RECALL - (LEAST_RECALL * (1 - LEAST_RECALL) / n) ** 0.5)  # noqa: E731 - a standard error less than allowed
    cuts = []
    for own in (held[held[:, 1] == 1][:, 2:], *(of(3, f) for f in SECRETS)):
        own = own[np.argsort(own[:, 0], kind="stable")]
        if n := int(own[:, 1].sum()):
            cuts.append(own[np.searchsorted(own[:, 1].cumsum(), int(lost(n) * n), "right"), 0])
    net.threshold = float(net.of_cells(np.array([min(cuts)]))[0]) if cuts else 0.5
    found = lambda rows: int(rows[net.of_cells(rows[:, 0]) >= net.threshold, 1].sum())
    families = {f: of(4, f) for f in (*SECRETS, *PLAIN)}
    net.families = {f: found(rows) / int(rows[:, 1].sum()) for f, rows in families.items() if len(rows)}
    secret, all_hit = last[last[:, 1] == 1][:, 2:], found(last[:, 2:])
    net.recall = found(secret) / int(secret[:, 1].sum()) if len(secret) else 0.0
    net.precision = found(secret) / all_hit if all_hit else 0.0


def train(windows: list[str], labels: list[int]) -> Network:
    """Trained on the first part of the rows; the second calibrates it and sets its threshold, the third is measured."""
    codes, y, part = encode(windows), np.array(labels, np.float64), np.array([_part(w) for w in windows], np.int64)
    net, fitted = _begun(), part < 3
    zeros = [np.zeros_like(p) for p in _params(net)]
    passes = max(PASSES, STEPS * 128 // max(1, int(fitted.sum())))
    state, _ = _passed((_params(net), zeros, zeros), 0, codes[fitted], y[fitted], float(y[fitted].mean()) if fitted.any() else 0.5, passes, [SEED, 0])
    net = Network(*state[0])
    counts = [(int(p), int(l), None, int(c), 1) for p, l, c in zip(part, y, net.cells(codes)) if p >= 3]
    for own in (3, 4):
        for family, found in _by_family(windows, part, own).items():
            counts += [(own, int(family in SECRETS), family, int(c), 1) for c in net.cells(encode(found))]
    _settle(net, counts)
    return net


def _by_family(windows: list[str], part: np.ndarray, own: int, n: int = CHECKED * 5, more: int = 0) -> dict[str, list[str]]:
    """Made-up strings of each family whose values lie in the part `own`, in surroundings of that part."""
    around = [w for w, p in zip(windows, part) if p == own]
    made, out = _made(around, n, SEED + 10 + own + more), {}
    for family, window in made:
        if _part(window) == own:
            out.setdefault(family, []).append(window)
    return out


def _calibrated(logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, the slope held near 1; each row stands for `n`."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (n * (y - p) * logits).sum() - (a - 1), (n * (y - p)).sum() - 0.1 * b
        h = np.array([[(w * logits**2).sum() + 1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, [ga, gb])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    return max(0.05, float(a)), float(b)


def _made(surroundings: list[str], n: int, seed: int) -> list[tuple[str, str]]:
    """(family, window) of `n` made-up strings, secrets and plain ones by turns, in the middle of borrowed surroundings."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    drawn = lambda letters, low, high: "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(low, high))))
    met = sorted({w for around in surroundings[:2000] for w in re.findall("[A-Za-z]{3,12}", around[:BEFORE] + "\0" + around[BEFORE + INSIDE :])})
    word = lambda: pick(met) if met and rng.random() < 0.7 else pick(_WORDLIST)
    number = lambda: str(int(rng.integers(1, 2030))) if rng.random() < 0.5 else ""
    hexes = "0123456789abcdef"
    make = {
        "hex": lambda: drawn(hexes, 18, 48),
        "base36": lambda: drawn(string.ascii_lowercase + string.digits, 18, 48),
        "upper": lambda: drawn(string.ascii_uppercase + string.digits, 18, 48),
        "base64": lambda: drawn(string.ascii_letters + string.digits + pick(("", "+/", "-_")), 18, 48),
        "prefixed": lambda: pick(_PREFIXES) + drawn(string.ascii_letters + string.digits, 18, 44),
        "letters": lambda: drawn(string.ascii_letters, 20, 48),
        "joined": lambda: pick(".-_/").join(word() + number() for _ in range(int(rng.integers(3, 6)))),
        "host": lambda: ".".join([pick(("www", "mail", "api", "cdn")) + number(), word().lower(), pick(("com", "org", "example", "net"))]) + pick(("", "/" + word() + "/" + word())),
        "uuid": lambda: "-".join(drawn(hexes, k, k + 1) for k in (8, 4, 4, 4, 12)),
        "camel": lambda: "".join(word().capitalize() for _ in range(int(rng.integers(3, 6)))) + number(),
        "date": lambda: f"{int(rng.integers(1990, 2040))}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}{pick(('', 'T10', '_'))}{pick(('', word()))}{pick(('.log', '.txt', '.tar.gz'))}",
    }
    out = []
    for i in range(n):
        around, family = pick(surroundings) if surroundings else "\0" * LENGTH, pick(PLAIN if i % 2 == 0 else SECRETS)
        before, after = around[:BEFORE], around[BEFORE + INSIDE :]
        out.append((family, before + make[family]()[:INSIDE].ljust(INSIDE, "\0") + after))
    return out


def made_findings(surroundings: list[str], n: int = MADE, more: int = 0) -> tuple[list[str], list[int]]:
    """Windows of made-up secrets (1) and plain identifiers (0), each in the middle of borrowed surroundings."""
    made = _made(surroundings, n, SEED + 1 + more)
    return [w for _, w in made], [int(f in SECRETS) for f, _ in made]


_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("plain", pa.bool_()), ("windows", pa.list_(pa.string()))]))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, found): base spans and other candidates of each text, with their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                found = base + [(a, "cnn", b) for a, b in candidates(text, base)]
                rows.append([{"start": a, "kind": k, "end": b, "plain": bool(_PLAIN.fullmatch(text, a, b) or _UUID.fullmatch(text, a, b)), "windows": windows(text, value_start(text, a, k), b)[: None if k == "cnn" else 1]} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _FOUND)], names=["doc_id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, found array<struct<start:int,kind:string,end:int,plain:boolean,windows:array<string>>>")


_EXAMPLE = "deal long, part int, y int, family string, window string"


def _examples(deals: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a deal's labelled windows: these, made-up ones in their surroundings, as many and MADE in all at least, and those of each family."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        deal = int(rows["deal"].iloc[0])
        rows = rows[rows["y"].notna()].sort_values(["y", "window"])
        windows, labels = rows["window"].tolist(), [int(y) for y in rows["y"]]
        seed = 100 * deal
        made = made_findings([w for w, y in zip(windows, labels) if not y] or windows, max(len(windows), -(-MADE // deals)), seed)
        windows, labels = windows + made[0], labels + made[1]
        part = np.array([_part(w) for w in windows], np.int64)
        out = [(deal, p, y, None, w) for p, y, w in zip(part.tolist(), labels, windows)]
        for own in (3, 4):
            found = _by_family(windows, part, own, -(-CHECKED * 5 // deals), seed)
            out += [(deal, own, int(f in SECRETS), f, w) for f, of in found.items() for w in of]
        return pd.DataFrame(out, columns=["deal", "part", "y", "family", "window"])

    return run


def _round(state: tuple[list, list, list], t: int, share: float, passes: int, nth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a deal's rows: what `passes` passes over them make of the parameters."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, deal = rows.sort_values(["y", "window"]), int(rows["deal"].iloc[0])
        after, steps = _passed(state, t, encode(rows["window"].tolist()), rows["y"].to_numpy(np.float64), share, passes, [SEED, deal, nth])
        return pd.DataFrame([(deal, len(rows), steps, pickle.dumps(after))], columns=["deal", "n", "t", "state"])

    return run


def fit(found: DataFrame, labelled: int = LABELLED) -> Network:
    """A network from all distinct labelled findings; it knows its held-back recall and precision.

    Findings are dealt by hash, about 2 * `labelled` to a task. In each round every task makes a pass over its own from the
    same parameters, and their means, weighted by rows, begin the next. Calibration, threshold and report count all rows.
    """
    scratch = Scratch(found.sparkSession, "secrets-fit")
    y = F.when(F.col("x.kind") != "cnn", 1).when(F.col("x.plain"), 0).alias("y")
    rows = found.select(F.explode("found").alias("x")).select(F.col("x.windows")[0].alias("window"), y).where("y IS NOT NULL").distinct()
    rows = scratch.table(rows, "labelled")
    n = rows.count()
    deals = max(1, -(-n // (2 * labelled)))
    dealt = rows.select(F.pmod(F.xxhash64("window"), F.lit(deals)).cast("long").alias("deal"), "y", "window")
    empty = found.sparkSession.range(deals).select(F.col("id").alias("deal"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("string").alias("window"))
    examples = scratch.table(dealt.union(empty).groupBy("deal").applyInPandas(_examples(deals), _EXAMPLE), "examples")
    own = examples.where("part < 3 AND family IS NULL").select("deal", "y", "window")
    size, secrets = own.agg(F.count("*"), F.sum("y")).first()
    passes, share = max(PASSES, STEPS * 128 * deals // max(1, size)), (secrets or 0) / max(1, size)
    state, t = ([*_params(_begun())], *([np.zeros_like(p) for p in _params(_begun())] for _ in range(2))), 0
    rounds, each = (1, passes) if deals == 1 else (passes, 1)
    for nth in range(rounds):
        run = _round(state, t, share, each, nth)
        after = sorted(map(tuple, own.groupBy("deal").applyInPandas(run, "deal long, n long, t long, state binary").collect()))
        total, t = sum(r[1] for r in after), max((r[2] for r in after), default=t)
        means = [[np.zeros(x.shape) for x in xs] for xs in state]
        for _, rows_of, _, raw in after:
            for xs, ys in zip(means, pickle.loads(raw)):
                for x, part in zip(xs, ys):
                    x += part * (rows_of / total)
        state = tuple([x.astype(old.dtype) for x, old in zip(xs, olds)] for xs, olds in zip(means, state))
    net = Network(*state[0])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(net.cells(encode(batch.column(3).to_pylist())), pa.int64())], names=["part", "y", "family", "cell"])

    placed = examples.where("part >= 3").select("part", "y", "family", "window").mapInArrow(cells, "part int, y int, family string, cell long")
    _settle(net, [tuple(r) for r in placed.groupBy("part", "y", "family", "cell").count().orderBy("part", "y", "family", "cell").collect()])
    net.findings = n
    return net


def _line(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn.

    Spans count code points, ends exclusive. A null or empty text has none. Repeated rows and null ids
    keep their rows. Other columns are not read.
    """
    found = Scratch(docs.sparkSession, "secrets").table(_found(docs, id_col, text_col), "found")
    net = fit(found, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_found = batch.column(1).to_pylist()
            scores = iter(net.probability(encode([w for f in docs_found for x in f if x["kind"] == "cnn" for w in x["windows"]])).tolist())
            rows = []
            for f in docs_found:
                scored = [((x["start"], x["kind"], x["end"]), max(next(scores) for _ in x["windows"]) if x["kind"] == "cnn" else 1.0) for x in f]
                base = [s for s, _ in scored if s[1] != "cnn"]
                added = [s for s, p in scored if s[1] == "cnn" and p >= net.threshold]
                count = [sum(s[1] == k for s in base) for k in KINDS[:3]]
                rows.append((*count, hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + added), len(added)))
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")
