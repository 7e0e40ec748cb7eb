"""Per-document text statistics, and a model that tells prose from lists, tables and junk.

Method: gradient-boosted trees over document statistics. The training rows are
weakly labelled: a bounded sample of the corpus by confident rules, and lists,
tables and junk made from the words of that sample; documents on which the
rules are unsure train nothing and are decided by the model alone. The class
probabilities are calibrated (temperature and class offsets) on the hand-checked
texts of `quality_holdout`.

Every statistic is computed over the whole text of every document. A null text
has null statistics, a blank one zeros; neither has a kind. The training sample
has at most TRAIN_DOCS documents, chosen by a hash of the id, copies of one text
counting as one. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import textwrap
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.quality_holdout import HOLDOUT

KINDS = ("prose", "list", "table", "junk")
TRAIN_DOCS = 4_000
#: Made examples of each structural kind.
MADE = 400
#: Longer texts are trained on, but no examples are made from them.
MADE_FROM = 20_000

# Frequent function words of English, German, French and Spanish.
COMMON = frozenset(
    """
    the of and to in a is that it was for on are as with be at by this have from or had not but what were when we there can an
    your which their if will each about how up out them then she many some so these would other into has more two no could my
    than been who its now did after before because while until he you they i
    der die das und ist in den von zu mit sich des auf für nicht ein eine einer einen dem als auch es an werden aus er hat dass
    sie nach wird bei noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wir ich
    le la les de des du un une et est en que qui dans pour pas au aux sur se ne ce il elle par plus avec son sa ses mais ou
    nous vous ils été ont cette était sans comme avant après car parce
    el los las y que se del por con para una su al lo como más pero sus le ya o fue este ha sí porque esta son entre cuando muy
    sin sobre ser tiene también me hasta hay donde quien desde todo nos durante uno ni contra otros fueron aunque antes había
    """.split()
)
# Endings for made list items.
PURPOSES = ("for the next week", "to be sent back", "with a new cover", "para la casa", "für den Garten", "pour le bureau", "and the old key")
STATS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "lines", "words_per_line",
    "marked_lines", "item_lines", "item_chars", "row_lines", "row_chars", "prose_chars", "bare_lines", "code_lines",
    "inline_parts", "inline_words", "inline_chars", "distinct_words", "top_words", "phrase_ratio", "longest_token", "vowel_ratio",
    "hard_words", "mixed_tokens", "sentences", "upper_ratio", "packed",
)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARK = re.compile(r"\s*(?:[-*•–—+·▪◦‣]|\(?\d{1,4}[.):]|\(?[A-Za-z][.)]|\[[ xX]?\])\s+\S")
_QUOTE = re.compile(r"\s*>\s?")
_HEADING = re.compile(r"\s*#{1,6}\s")
_ENDS = frozenset(".!?…:。！？")
_CLOSERS = "\"'»”)]"
_STOP = re.compile(r"[.!?…。！？][\"'»”)\]]*(?=\s|$)")
_CODE = re.compile(r"\s*(?:[0-9A-Fa-f]{4,16}:?\s+)?(?:(?:[0-9A-Fa-f]{2}\s+){7,}[0-9A-Fa-f]{2}.*|[A-Za-z0-9+/=_-]{32,})\s*$")
_GAPS = re.compile(r"\S {2,}(?=\S)")
_RULE = re.compile(r"[\s|+\-=:_]+$")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxzßçñ]{5,}|^[bcdfghjklmnpqrstvwxz]{4,}$")
_BREAK = re.compile(r"\r\n|[\n\r  ]")
# Fixed value: the vowels of the Latin alphabet with their usual diacritics.
_VOWELS = frozenset("aeiouyäöüáéíóúàèìòùâêîôûœæåøë")
_SEPARATORS = (" / ", "; ", ";", ", ", ",", " | ", "|", " - ", " · ", " • ", "\t")


def _stops(line: str) -> bool:
    """Whether a line ends as a sentence does."""
    return line.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS


def _cells(line: str) -> dict[str, int]:
    """Number of separators of each kind that could part the line into cells."""
    bars = line.strip().strip("|").count("|")
    return {"|": bars, "\t": line.count("\t"), ";": line.count(";"), ",": line.count(","), " ": len(_GAPS.findall(line.strip())) if "  " in line else 0}


def _rows(lines: list[str]) -> list[bool]:
    """Which lines are rows of cells: they have as many cells as a neighbour and the cells are short."""
    counts = [_cells(x) for x in lines]
    rows = [False] * len(lines)
    for kind, least in (("|", 1), ("\t", 1), (";", 1), (",", 1), (" ", 1)):
        for i, line in enumerate(lines):
            n = counts[i][kind]
            if rows[i] or n < least:
                continue
            near = [counts[j][kind] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            # Aligned columns may lack an empty cell, so a near match will do for them.
            alike = any(abs(n - m) <= (n > 1 and m > 0) for m in near) if kind == " " else n in near
            if not alike:
                continue
            words = len(line.split())
            per_cell = words / (n + 1)
            if kind == "," and (", " in line and per_cell > 1.6 or n < 2 and ", " in line or per_cell > 3):
                continue
            if kind in ";," and (per_cell > 3.2 or _STOP.search(line) and per_cell > 2):
                continue
            if kind == " " and per_cell > 4:
                continue
            rows[i] = True
    for i, line in enumerate(lines):  # rulings between rows
        if not rows[i] and _RULE.match(line) and any(0 <= j < len(lines) and rows[j] for j in (i - 1, i + 1)):
            rows[i] = True
    return rows


def _inline(text: str) -> tuple[float, float, float]:
    """Parts of the best separator, their mean words, and the share of the text in short parts."""
    best = (0.0, 0.0, 0.0)
    for separator in _SEPARATORS:
        n = text.count(separator)
        if n < 3:
            continue
        parts = text.split(separator)
        short = [p for p in parts if len(p.split()) <= 5 and not _STOP.search(p)]
        share = sum(len(p) for p in short) / max(1, sum(map(len, parts)))
        if (share, n) > (best[2], best[0]):
            best = (float(len(parts)), len(text.split()) / len(parts), share)
    return best


@lru_cache(maxsize=65_536)
def _sort(char: str) -> str:
    """``l`` vowel letter, ``c`` other Latin letter, ``o`` letter, ``m`` mark, ``d`` number, ``s`` white space, ``y`` symbol, ``p`` the rest."""
    kind = unicodedata.category(char)
    if kind[0] == "L":
        return "l" if char.lower() in _VOWELS else "c" if unicodedata.name(char, "").startswith("LATIN") else "o"
    if kind[0] == "M":
        return "m"
    if kind == "No" or kind[0] == "S" and not char.isascii() or char in "¶§¿¡‚„":
        return "y"
    if kind[0] == "N":
        return "d"
    return "s" if char.isspace() else "p"


def _mixed(token: str) -> bool:
    """Whether a word holds odd symbols next to letters or to each other."""
    sorts = "".join(map(_sort, token.strip("¿¡„‚\"'.,;:!?()[]")))
    return "y" in sorts and len(sorts) > 1 and ("yy" in sorts or any(c in sorts for c in "lco"))


def _is_prose_block(lines: list[str]) -> bool:
    """Whether consecutive plain lines read as running text that is merely broken into lines."""
    text = " ".join(lines)
    words = _WORD.findall(text.lower())
    if len(words) < 6:
        return False
    common = sum(w in COMMON for w in words) / len(words)
    if common >= 0.24:
        return True
    stops = len(_STOP.findall(text))
    ends = sum(map(_stops, lines))
    # Sentences that run over line ends: fewer lines than stops would make stop, and the last one does.
    return stops > 0 and stops * 40 >= len(words) and len(words) >= 4 * len(lines) and _stops(lines[-1]) and (ends < len(lines) or len(words) >= 9 * len(lines))


def _line_kinds(lines: list[str]) -> list[str]:
    """``row``, ``code``, ``item``, ``prose`` or ``heading`` for each line that is not blank."""
    rows = _rows(lines) if len(lines) > 1 else [False] * len(lines)
    kinds, block = [""] * len(lines), []

    def close() -> None:
        if not block:
            return
        prose = _is_prose_block([lines[i] for i in block])
        for i in block:
            n = len(lines[i].split())
            kinds[i] = "prose" if prose or n > 8 or _stops(lines[i]) and n > 3 else "item"
        block.clear()

    for i, line in enumerate(lines):
        if _CODE.match(line):
            kinds[i] = "code"
        elif rows[i]:
            kinds[i] = "row"
        elif _MARK.match(line):
            kinds[i] = "item" if len(line.split()) <= 13 else "prose"
        elif _HEADING.match(line):
            kinds[i] = "heading"
        else:
            block.append(i)
            continue
        close()
    close()
    return kinds


def statistics(text: str) -> list[float]:
    """The values of STATS for one text."""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    tally = Counter()
    upper = 0
    for char, count in Counter(text).items():
        tally[_sort(char)] += count
        if char.isupper():
            upper += count
    letters = tally["l"] + tally["c"] + tally["o"]
    chars = max(1, len(text) - tally["s"])
    lines = [_QUOTE.sub("", x, count=1) for x in _BREAK.split(text)]
    lines = [x for x in lines if x and not x.isspace()]
    m = max(1, len(lines))
    kinds = _line_kinds(lines)
    size = Counter()
    for line, kind in zip(lines, kinds):
        size[kind] += len(line.strip())
    total = max(1, sum(size.values()))
    line_kinds = Counter(kinds)
    marked = sum(bool(_MARK.match(x)) for x in lines)
    punctuated = sum(map(_stops, lines))
    bare = sum(not any(map(str.isalpha, x)) for x in lines)
    count = Counter(words)
    triples = set(zip(words, words[1:], words[2:]))
    hard = latin = common = 0
    for w, c in count.items():
        if w in COMMON:
            common += c
        elif len(w) >= 4 and w[0] <= "ɏ":
            latin += c
            if _HARD.search(w):
                hard += c
    latin += sum(c for w, c in count.items() if w in COMMON and len(w) >= 4)
    tokens = text.split()
    mixed = sum(map(_mixed, tokens)) if tally["y"] else 0
    plain = text if len(lines) < 3 else "\n".join(x for x, k in zip(lines, kinds) if k != "row")
    parts, part_words, part_chars = _inline(plain)
    encoded = text.encode("utf-8", "replace")
    return [
        float(len(words)),
        sum(map(len, words)) / n,
        (tally["p"] + tally["y"]) / chars,
        tally["d"] / chars,
        punctuated / m,
        common / n,
        float(len(lines)),
        len(words) / m,
        marked / m,
        line_kinds["item"] / m,
        size["item"] / total,
        line_kinds["row"] / m,
        size["row"] / total,
        size["prose"] / total,
        bare / m,
        line_kinds["code"] / m,
        parts,
        part_words,
        part_chars,
        len(count) / n,
        sum(c for _, c in count.most_common(3)) / n,
        len(triples) / max(1, len(words) - 2),
        float(max(map(len, tokens), default=0)),
        tally["l"] / max(1, tally["l"] + tally["c"]),
        hard / max(1, latin),
        mixed / max(1, len(tokens)),
        len(_STOP.findall(text)) / n,
        upper / max(1, letters),
        len(zlib.compress(encoded, 1)) / max(1, len(encoded)),
    ]


_AT = {name: i for i, name in enumerate(STATS)}


def weak_label(s: list[float]) -> str | None:
    """The kind of a text whose statistics leave no doubt, else None: about a tenth of a mixed corpus is left to the model alone."""
    v = lambda name: s[_AT[name]]
    if v("words") + v("lines") == 0:
        return None
    if v("code_lines") > 0.95 or v("bare_lines") > 0.95 and v("row_lines") < 0.2 or v("mixed_tokens") > 0.7:
        return "junk"
    if v("words") >= 20 and (v("top_words") > 0.97 or v("hard_words") > 0.4 and v("common_words") < 0.05):
        return "junk"
    if v("row_chars") > 0.9 and v("common_words") < 0.1 and v("lines") >= 4:
        return "table"
    if v("prose_chars") > 0.85 and v("common_words") > 0.3 and v("row_chars") < 0.05 and v("phrase_ratio") > 0.6 and v("item_lines") < 0.3:
        return "prose"
    if v("item_lines") > 0.9 and v("item_chars") > 0.85 and v("lines") >= 5 and v("common_words") < (0.3 if v("marked_lines") > 0.9 else 0.12):
        return "list"
    if v("lines") <= 2 and v("inline_parts") >= 8 and v("inline_chars") > 0.92 and v("common_words") < 0.1:
        return "list"
    return None


def _made(texts: list[str], rng: random.Random) -> Iterator[tuple[str, str]]:
    """Lists, tables and junk in many dresses, made from the words of `texts`."""
    words = [w for t in texts for w in _WORD.findall(t) if len(w) > 2] or ["node", "edge", "label", "graph", "path"]
    plain = [w for w in words if w.lower() not in COMMON] or words
    some = lambda a, b: " ".join(rng.choice(plain) for _ in range(rng.randint(a, b)))
    intro = lambda: rng.choice([t for t in texts if t] or [""]).split(". ")[0].replace("\n", " ")[:120] + "."
    for _ in range(MADE):
        items = [rng.choice(["", "", "", "the "]) + some(1, 5) for _ in range(rng.randint(4, 40))]
        style = rng.choice(["-", "*", "•", "–", "1.", "a)", "[ ]", "", "", "sep"])
        if style == "sep":
            yield "list", rng.choice([" / ", ", ", "; ", " | ", ",", " · "]).join([*items, some(1, 3), some(1, 3)])
        else:
            mark = lambda i: f"{i + 1}. " if style == "1." else f"{chr(97 + i % 26)}) " if style == "a)" else style + " " * bool(style)
            if style and rng.random() < 0.3:  # items as short phrases with a full stop
                items = [f"{x[:1].upper()}{x[1:]} {rng.choice(PURPOSES)}." for x in items]
            if texts and rng.random() < 0.25:  # a passage of prose among the items
                items.insert(rng.randint(0, len(items)), " ".join(rng.choice(texts).split())[: rng.randint(80, 600)])
            text = "\n".join("    " * (rng.random() < 0.2) + mark(i) + x for i, x in enumerate(items))
            yield "list", rng.choice(["", "", some(1, 4) + "\n", intro() + "\n"]) + text
        width = rng.randint(2, 7)
        cell = lambda: rng.choice([some(1, 2), str(rng.randint(0, 99999)), f"{rng.random() * 100:.3f}", f"20{rng.randint(10, 40)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", "", "-", "n/a"])
        grid = [[cell() or rng.choice(["", "x"]) for _ in range(width)] for _ in range(rng.randint(4, 40))]
        style = rng.choice(["|", "\t", ",", ";", " ; ", " ", "+"])
        if style == "|":
            rows = ["| " + " | ".join(r) + " |" for r in grid]
            rows.insert(1, "|---" * width + "|")
        elif style in " +":
            wide = [max(len(r[c]) for r in grid) for c in range(width)]
            rows = [("| " if style == "+" else "") + (" | " if style == "+" else "  ").join(x.ljust(w) for x, w in zip(r, wide)).rstrip() + (" |" if style == "+" else "") for r in grid]
            if style == "+":
                rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
                rows = [rule, rows[0], rule, *rows[1:], rule]
        else:
            rows = [style.join(r) for r in grid]
        yield "table", rng.choice(["", "", intro() + "\n"]) + "\n".join(rows)
        style = rng.randint(0, 6)
        letters = "abcdefghijklmnopqrstuvwxyz"
        if style == 0:
            alphabet = letters + letters.upper() + "0123456789+/"
            yield "junk", "\n".join("".join(rng.choice(alphabet) for _ in range(76)) for _ in range(rng.randint(2, 20)))
        elif style == 1:
            yield "junk", "\n".join(f"{16 * i:08x}  " + " ".join(f"{rng.randint(0, 255):02x}" for _ in range(16)) for i in range(rng.randint(2, 20)))
        elif style == 2:
            yield "junk", "\n".join(rng.choice("=-~*#._+%") * rng.randint(8, 70) + rng.choice(["", "", f" {rng.randint(0, 99)}"]) for _ in range(rng.randint(3, 30)))
        elif style == 3:
            yield "junk", " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 15))) for _ in range(rng.randint(15, 150)))
        elif style == 4:
            phrase = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
            yield "junk", rng.choice([" ", "! ", ", ", " ... ", "\n"]).join(rng.choice([phrase] * 9 + [phrase.upper()]) for _ in range(rng.randint(12, 200)))
        elif style == 5:
            odd = "ÃÂâ€œÐÑ¤¶¼½¿±¬‚ïŸ"
            yield "junk", " ".join("".join(rng.choice(odd) for _ in range(rng.randint(1, 9))) + rng.choice(["", "er", "n"]) for _ in range(rng.randint(15, 120)))
        else:
            yield "junk", "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(60, 900)))


def _redressed(text: str, rng: random.Random) -> Iterator[str]:
    """Prose that stays prose: in capitals, bare, wrapped, cut to a sentence, or around a few items or rows."""
    words = text.split()
    some = lambda: " ".join(rng.sample(words, min(len(words), rng.randint(1, 3))))
    yield text.upper()
    yield " ".join(_WORD.findall(text.lower()))
    yield "\n".join(textwrap.wrap(text, rng.randint(22, 72)))
    yield _STOP.split(text, maxsplit=1)[0].replace("\n", " ") + "."
    few = rng.randint(2, 4)
    rows = "\n".join(rng.choice(["- {}", "* {}", "{}"]).format(some()) for _ in range(few))
    mark = rng.choice([" | ", ",", "\t", " ; "])
    cells = "\n".join(mark.join((rng.choice(words), str(rng.randint(0, 999)))) for _ in range(few))
    yield f"{text}\n\n{rng.choice((rows, cells))}\n\n{text[: len(text) // 2]}"
    yield f"{text}\n\n{rows}"
    thin = " ".join(w for w in words if w.lower() not in COMMON or rng.random() < 0.75)  # with fewer function words
    yield thin
    yield "\n".join(textwrap.wrap(thin, rng.randint(30, 72)))


# ---- gradient-boosted trees --------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Softmax boosting of histogram trees of fixed depth."""

    edges: list[np.ndarray]
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # per round and class: feature, bin, leaf value
    prior: np.ndarray
    rate: float
    depth: int
    temperature: float = 1.0
    offset: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        prior = np.log((np.bincount(y, minlength=classes) + 1.0) / (len(y) + classes))
        # Classes weigh alike, whatever the mixture of the sample is.
        weight = (len(y) / classes / np.maximum(1, np.bincount(y, minlength=classes)))[y]
        score = np.tile(prior, (len(y), 1))
        own = cls(edges, [], prior, rate, depth)
        for _ in range(rounds):
            p = _softmax(score)
            trees = []
            for k in range(classes):
                g = weight * (p[:, k] - (y == k))
                h = weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                tree = cls._grow(binned, g, h, depth, bins)
                score[:, k] += rate * tree[2][cls._leaf(binned, tree, depth)]
                trees.append(tree)
            own.trees.append(trees)
        return own

    @staticmethod
    def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, bins)
        node = np.zeros(len(g), int)
        regular, least = 1.0, 4.0
        for level in range(depth):
            base, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for f in range(binned.shape[1]):
                at = (node - base) * bins + binned[:, f]
                gs = np.bincount(at, g, count * bins).reshape(count, bins).cumsum(1)
                hs = np.bincount(at, h, count * bins).reshape(count, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + regular) + (gt - gs) ** 2 / (ht - hs + regular) - gt**2 / (ht + regular)
                gain[(hs < least / 16) | (ht - hs < least / 16)] = 0
                where = gain.argmax(1)
                top = gain[np.arange(count), where]
                better = top > best
                best[better] = top[better]
                feature[base : base + count][better] = f
                cut[base : base + count][better] = where[better]
            right = binned[np.arange(len(g)), feature[node]] > cut[node]
            node = 2 * node + 1 + right
        leaf = node - (2**depth - 1)
        value = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + regular)
        return feature, cut, value

    @staticmethod
    def _leaf(binned: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
        feature, cut, _ = tree
        node, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return node - (2**depth - 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        score = np.tile(self.prior, (len(x), 1))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                score[:, k] += self.rate * tree[2][self._leaf(binned, tree, self.depth)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Temperature and class offsets that maximise the likelihood of held-out rows."""
        m, classes = self.margins(x), len(self.prior)
        truth = np.eye(classes)[y]
        log_scale, offset = 0.0, np.zeros(classes)
        for _ in range(400):
            p = _softmax(m * np.exp(log_scale) + offset)
            slope = (truth - p) / len(y)
            offset += 1.0 * (slope.sum(0) - 0.02 * offset)
            log_scale += 0.2 * float((slope * m).sum() * np.exp(log_scale) - 0.02 * log_scale)
        self.temperature, self.offset = float(np.exp(-log_scale)), offset

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.margins(x) / self.temperature + (0 if self.offset is None else self.offset))


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], seed: int = 11) -> BoostedTrees:
    """A calibrated model from weakly labelled texts and made structural ones."""
    measured = [(statistics(t), t) for t in texts]
    return _train([(s, t) for s, t in measured if weak_label(s)], seed)


def _train(labelled: list[tuple[list[float], str | None]], seed: int) -> BoostedTrees:
    """`labelled`: statistics on which the weak rules are sure, with the text if it may serve for making further examples."""
    rows = [s for s, _ in labelled]
    labels = [KINDS.index(weak_label(s)) for s in rows]
    prose = [t for (_, t), k in zip(labelled, labels) if k == 0 and t]
    rng = random.Random(seed)
    for kind, text in _made(prose[:500], rng):
        rows.append(statistics(text))
        labels.append(KINDS.index(kind))
    for text in prose[: MADE // 2]:
        for other in _redressed(text, rng):
            rows.append(statistics(other))
            labels.append(0)
    checked = list(HOLDOUT)
    if 0 not in labels:  # a corpus without prose: every other checked text of prose is learnt from, and not calibrated on
        lent = [x for x in checked if x[0] == "prose"][::2]
        checked = [x for x in checked if x not in lent]
        for _, text in lent:
            rows.append(statistics(text))
            labels.append(0)
    model = BoostedTrees.fit(np.array(rows), np.array(labels), len(KINDS))
    model.calibrate(np.array([statistics(t) for _, t in checked]), np.array([KINDS.index(k) for k, _ in checked]))
    return model


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statistics of the texts that the weak rules are sure of; prose of moderate length comes along."""
    for batch in batches:
        texts = batch["text"].to_pylist()
        found = [(s, t if weak_label(s) == "prose" and len(t) <= MADE_FROM else None) for s, t in ((statistics(t), t) for t in texts) if weak_label(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([t for _, t in found], pa.string())], names=["stats", "text"]
        )


def fit_on(documents: DataFrame, seed: int = 11) -> BoostedTrees:
    """Train on at most TRAIN_DOCS distinct documents of the corpus, chosen by a hash of their id."""
    total = documents.count()  # reads no text
    filled = documents.where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0))
    if total > 2 * TRAIN_DOCS:
        bar = int((2.0 * TRAIN_DOCS / total - 0.5) * 2**64 * 0.999999999)
        filled = filled.where(F.xxhash64("doc_id", F.lit(seed)) <= bar)
    turn = F.xxhash64("text", F.lit(seed + 1))
    drawn = filled.select(F.col("text").cast("string").alias("text")).dropDuplicates(["text"]).orderBy(turn, "text").limit(TRAIN_DOCS)
    tasks = documents.sparkSession.sparkContext.defaultParallelism
    rows = drawn.repartition(tasks).mapInArrow(_sampler, "stats array<double>, text string").collect()
    # Statistics and text decide the order, not the tasks they came from.
    return _train(sorted(((list(r.stats), r.text) for r in rows), key=lambda r: (zlib.crc32((r[1] or "").encode("utf-8", "replace")), r[0])), seed)


# ---- over a corpus ------------------------------------------------------------------------

_DDL = ", ".join(f"{name} double" for name in STATS)


def _measure(model: BoostedTrees | None):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            rows = [None if t is None else statistics(t) for t in texts]
            columns = [pa.array([None if r is None else r[i] for r in rows], pa.float64()) for i in range(len(STATS))]
            if model is None:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *STATS])
                continue
            at = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            kind: list[str | None] = [None] * len(texts)
            sure: list[float | None] = [None] * len(texts)
            if at:
                p = model.probabilities(np.array([rows[i] for i in at]))
                for i, row in zip(at, p):
                    kind[i], sure[i] = KINDS[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(kind, pa.string()), pa.array(sure, pa.float64()), *columns],
                names=["doc_id", "kind", "probability", *STATS],
            )

    return measure


def document_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and all STATS of every document."""
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_measure(None), f"doc_id bigint, {_DDL}")


def document_kinds(documents: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """``doc_id, kind, probability`` and all STATS; the model is trained on the corpus unless given."""
    model = model or fit_on(documents)
    ddl = f"doc_id bigint, kind string, probability double, {_DDL}"
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_measure(model), ddl)
