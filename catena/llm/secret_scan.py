"""Secret scanning: candidates by pattern, false positives removed by a random forest.

Candidates lie within words: known key formats, values assigned to a name (in the word
itself, in JSON or a URL, or announced by the words before), long runs of mixed characters, and blocks of private keys.
For each the forest sees the candidate's length, its character transitions (how likely its letters follow each other,
and how often the kind of character changes), how much of it a dictionary covers, its path and the words
beside it.  Dictionary and transitions are counted over all words of the table (``learn_language``).  The forest
(numpy, trained here) learns from labelled findings, given by the caller or made up by ``labelled_findings``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.llm import base

_TELLS = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credential|bearer)"
#: A word is looked at (RE2) if it assigns a value to a telling name, holds a password in a URL, or has a run of 16 or more key characters and a digit.
ASSIGNED = rf"(?i){_TELLS}[A-Za-z0-9_.\-]*[\"']?\]?(:=|=>|[=:])|://[^/\s:@]*:\S{{6,}}@"
RUN = r"[A-Za-z0-9_\-./+=~]{16,}"
#: A word that announces the next one as a value: a telling name, with or without a sign of assignment; or that sign alone.
CUE = rf"(?i)^[^A-Za-z0-9]*[A-Za-z0-9_.\-]*{_TELLS}[A-Za-z0-9_.\-]*[\"']?\]?(:=|=>|[=:])?$"
SIGN = r"^(:=|=>|[=:])$"
PAIR = re.compile(rf"(?i)(?P<name>[A-Za-z0-9_.\-]*{_TELLS}[A-Za-z0-9_.\-]*)[\"']?\]?(?::=|=>|[=:])(?:\"(?P<double>[^\"]{{6,}})|'(?P<single>[^']{{6,}})|(?P<bare>[^\"'\s]\S{{5,}}))")
URL = re.compile(r"://[^/\s:@]*:(\S{6,})@")
RUNS = re.compile(RUN)
#: Letters alone make a run a candidate if they change their case often.
MIXED = r"[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z]"
LETTERS = re.compile(MIXED)
CORE = re.compile(r"^[^A-Za-z0-9]*(?:(?P<name>[A-Za-z_\-]{2,32})[\"']?[=:][\"']?)?(?P<value>[A-Za-z0-9_\-./+=~]{8,})[^A-Za-z0-9=]*$")
SHORTEST = 16
#: Words that candidates, paths and neighbours are compared with.
DICTIONARY = """account admin alpha api app area asset auth author backup base beta book build cache change channel client code color config content core count create
data date debug default delta demo device doc document dummy engine error event example fake file final first foo bar free gamma global group hash home host image index info
input item key label language level line list local log main master member message method mock model name network node number object order output page part path phone place
plugin point project public query read record release remote report sample schema secret section server service session set setting site source start state static status
string style system table test text time token type update url user value version video view web world write""".split()
TELLING = frozenset("password passwd pass pwd secret token key apikey api_key auth authorization bearer credential credentials private access aws".split())
HARMLESS = frozenset("example sample test dummy fake placeholder commit sha hash checksum md5 sha1 sha256 digest uuid id version isbn phone tel call order invoice ip address card".split())
FORMATS = [re.compile(p) for p in (r"^(AKIA|ASIA)[A-Z0-9]{16}$", r"^gh[pousr]_[A-Za-z0-9]{30,}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$", r"^sk_(live|test)_[A-Za-z0-9]{16,}$", r"^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", r"^AIza[A-Za-z0-9_-]{30,}$")]
FEATURES = ["length", "entropy", "class_changes", "digit_share", "upper_share", "vowel_share", "hex_only", "digits_only", "punctuation_share", "dictionary_share", "letter_transitions", "worst_transitions", "known_format", "telling_name", "telling_near", "harmless_near", "path_harmless", "path_config", "separators"]
#: Words of the table that its dictionary holds at most, their lengths, and how often one must come.
MOST_WORDS, WORD_LENGTHS, WORD_SUPPORT = 4096, (4, 14), 5
#: A private key: its begin line and the base64 lines that follow it.
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:\s|\\n)*+((?:[A-Za-z0-9+/=]{16,}+(?:\s|\\n)*+)++)")


@dataclass(frozen=True)
class Language:
    """The dictionary, and the log-probability of each letter after another (26: any other character)."""

    words: tuple[str, ...]
    follows: tuple[tuple[float, ...], ...]


def language_of(counts: dict[str, int]) -> Language:
    """From words and how often they come, together with the words that candidates are always compared with."""
    both = counts | {w: counts.get(w, 0) + WORD_SUPPORT for w in DICTIONARY}
    pairs = np.ones((27, 27))
    for w, n in both.items():
        c = [min(ord(x) - 97, 26) if "a" <= x <= "z" else 26 for x in w.lower()]
        np.add.at(pairs, (c[:-1], c[1:]), n)
    follows = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    return Language(tuple(sorted(both)), tuple(map(tuple, follows.tolist())))


def learn_language(docs: DataFrame, most: int = MOST_WORDS) -> Language:
    """The most frequent words of the whole table, at most ``most`` of them, with the transitions of their letters.

    Every text counts, whole; counts are combined before they are shuffled.  How many words come how often tells from what count on there are
    few enough, so only the words that are taken go to the driver.
    """
    low, high = WORD_LENGTHS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.slices(whole):
                _, words = base.split_words(batch.column("text"))
                found = pc.value_counts(words)
                plain = pc.utf8_lower(pc.utf8_trim(found.field("values"), characters=string.punctuation))
                good = pc.and_(pc.utf8_is_alpha(plain), pc.and_(pc.greater_equal(pc.utf8_length(plain), low), pc.less_equal(pc.utf8_length(plain), high)))
                yield pa.RecordBatch.from_arrays([plain.filter(good), found.field("counts").filter(good)], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(base.trimmed(count), "word string, n long")
    counted = base.store(rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= WORD_SUPPORT), "word-counts")
    # One row a count: few, as counts that differ add up.
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    bound = counted.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).where(F.col("upto") <= most).agg(F.min("n")).head()[0]
    if bound is None:
        return language_of({})
    return language_of({r["word"]: r["n"] for r in counted.where(F.col("n") >= bound).collect()})


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, len(w))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def built_in() -> Language:
    """The language of the fixed words alone."""
    return language_of({})


def _classes(s: str) -> list[int]:
    return [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]


def _transitions(low: str, language: Language) -> tuple[float, float]:
    """Mean log-probability of neighbouring letters, and the mean of its worst quarter; 0 without two letters side by side."""
    c = [ord(x) - 97 if "a" <= x <= "z" else 26 for x in low]
    found = sorted(language.follows[a][b] for a, b in zip(c, c[1:], strict=False) if a < 26 and b < 26)
    if not found:
        return 0.0, 0.0
    worst = found[: max(1, len(found) // 4)]
    return sum(found) / len(found), sum(worst) / len(worst)


def describe(name: str, value: str, path: str, before: str, after: str, language: Language | None = None) -> list[float]:
    """The features of a candidate."""
    language = language or built_in()
    n, kinds, low = len(value), _classes(value), value.lower()
    counts = [value.count(c) for c in set(value)]
    covered = np.zeros(n, dtype=bool)
    for end, size in _automaton(language.words).iter(low) if len(low) == n else ():
        covered[end + 1 - size : end + 1] = True
    near = {w.strip(string.punctuation).lower() for w in (*before.split(), *after.split())}
    names = set(re.split(r"[^a-z0-9]+", name.lower())) | {name.lower().replace("-", "_")}
    parts = set(re.split(r"[^a-z0-9]+", path.lower()))
    return [
        float(min(n, 128)), -sum(c / n * math.log2(c / n) for c in counts), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), kinds.count(2) / n, kinds.count(1) / n,
        sum(c in "aeiou" for c in low) / n, float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None), float(value.isdigit()), kinds.count(3) / n, float(covered.mean()), *_transitions(low, language),
        float(any(p.match(value) for p in FORMATS)), float(bool(names & TELLING)), float(bool(near & TELLING)), float(bool((near | names) & HARMLESS)),
        float(bool(parts & {"test", "tests", "example", "examples", "docs", "fixtures", "sample"})), float(bool(parts & {"env", "config", "settings", "secrets", "yml", "yaml", "ini"})), float(sum(c in "-.:/" for c in value)),
    ]


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, str, int]]:
    """Made-up findings (name, value, path, word before, word after, label): key formats and random values that are secret, look-alikes that are not."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    letters, hexes, upper = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    syllables = "an en er in on re st th ti to ou ea ha he es ed or al le ma".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
    path = lambda kind: r.choice(["src/app.py", "config/settings.yml", ".env", "lib/main.js", f"src{r.randint(0, 19)}", "deploy/prod.ini"] if kind else ["tests/test_app.py", "docs/index.md", "src/app.py", f"src{r.randint(0, 19)}", "examples/run.sh"])
    out = []
    for i in range(n):
        before, after = word(), word()
        if i % 2:
            kind = r.randrange(7)
            name = r.choice(["password", "token", "secret", "api_key", "db-password", "auth"])
            value = [lambda: r.choice(["AKIA", "ASIA"]) + pick(upper, 16), lambda: "ghp_" + pick(letters, 36), lambda: "sk_live_" + pick(letters, 24), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(letters, 24), lambda: pick(hexes, r.choice([16, 18, 24, 32, 40])), lambda: pick(letters, r.randint(16, 44)), lambda: pick(letters + "-_", 40)][kind]()
            if kind >= 4:
                if r.random() < 0.7:
                    out.append((name, value, path(1), before, after, 1))
                else:
                    out.append(("", value, path(1), r.choice(["token =", "password:", "secret =", "key:", "bearer"]), after, 1))
            else:
                out.append((r.choice(["", "", name]), value, path(1), r.choice([before, before, "key"]), after, 1))
        else:
            kind = r.randrange(9)
            value = [
                lambda: pick(string.digits, 16), lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)) + ":" + str(r.randint(1000, 65000)), lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: pick(hexes, r.choice([32, 40, 64])),
                lambda: "_".join(r.choice(DICTIONARY) for _ in range(r.randint(2, 5))) + str(r.randint(1, 99)), lambda: word() + str(r.randint(1, 99)) + "." + word() + word() + ".example.com", lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T10:{r.randint(10, 59)}:00",
                lambda: r.choice(["your", "my", "the"]) + "-" + "-".join(r.choice(DICTIONARY) for _ in range(3)) + "-here1", lambda: "/".join(r.choice(DICTIONARY) for _ in range(4)) + "/v" + str(r.randint(1, 20)),
            ][kind]()
            near = r.choice(["commit", "sha", "checksum", "hash:"]) if kind == 3 else r.choice([before, "id", "phone", "version", "example"])
            out.append((r.choice(["password", "token"]) if kind == 7 else "", value, path(0), near, after, 0))
    # Keys of letters alone and blocks of private keys; identifiers made of words.
    for i in range(n // 6):
        if i % 2:
            block = r.random() < 0.3
            value = "MII" + pick(letters + "+/", 64 * r.randint(4, 24)) if block else pick(string.ascii_letters, r.randint(20, 40))
            out.append(("private key" if block else r.choice(["", "", "api_key", "token"]), value, path(1), word(), word(), 1))
        else:
            first, *rest = (r.choice([word(), r.choice(DICTIONARY)]) for _ in range(r.randint(4, 8)))
            out.append(("", (first + "".join(w.capitalize() for w in rest))[:60], path(0), word(), word(), 0))
    # Short passwords and passphrases under telling names, and what such names have in prose and templates.
    for i in range(n // 4):
        name = r.choice(["password", "pwd", "passwd", "DB_PASSWORD", "db_password", "secret", "token"])
        if i % 2:
            value = [lambda: pick(letters, r.randint(4, 10)) + r.choice("0123456789") + pick("!@&#$%", r.randint(0, 2)) + pick(letters, r.randint(1, 4)), lambda: pick(string.ascii_lowercase, r.randint(3, 8)) + pick(string.digits, r.randint(1, 4)) + pick(string.ascii_lowercase, r.randint(0, 3)), lambda: "".join(word() for _ in range(r.randint(5, 8))), lambda: "".join(r.choice([word(), r.choice(DICTIONARY)]) for _ in range(r.randint(4, 6)))][r.randrange(4)]()
            out.append((name, value, path(1), word(), word(), 1))
        else:
            value = r.choice([lambda: r.choice(DICTIONARY), lambda: r.choice(["changeme", "required", "<password>", "${PASSWORD}", "optional", "undefined", "string", "xxxxxxxx"]), lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))])()
            out.append((name, value, path(0), word(), word(), 0))
    return out


def values_in(word: str) -> list[tuple[str, str]]:
    """(name, value) of all candidates within a word."""
    found, at = [], 0
    while m := PAIR.search(word, at):
        value, at = m["double"] or m["single"] or m["bare"], m.end()
        if m["bare"]:
            # In a query an ampersand ends the value, in JSON a comma before the next name does, in lists a separator before an assignment.
            cut = re.search(r"[&#]", value) if "?" in word[: m.start()] or "://" in word[: m.start()] else re.search(r",[\"']|[,;&|][A-Za-z_][A-Za-z0-9_.\-]*=", value)
            if cut:
                value, at = value[: cut.start()], m.start("bare") + cut.start()
            value = value.rstrip(",;)]}>\"'.")
        if len(value) >= 6:
            found.append((m["name"], value))
    found += [("password", m[1]) for m in URL.finditer(word)]
    if not found and (m := CORE.match(word)) and len(m["value"]) >= SHORTEST:
        return [(m["name"] or "", m["value"])]
    runs = [m[0] for m in RUNS.finditer(word) if any(c.isdigit() for c in m[0]) or len(m[0]) >= 20 and LETTERS.search(m[0])]
    return found + [("", r) for r in runs if not any(v in r or r in v for _, v in found)]


def blocks_in(text: str) -> list[tuple[int, int, str]]:
    """Blocks of private keys: the index of the first word, of the first word after it, and the key without white space."""
    out = []
    for m in BLOCK.finditer(text):
        first = len(re.findall(base.WORD, text[: m.start()]))
        out.append((first, first + len(re.findall(base.WORD, m[0])), re.sub(r"\s|\\n", "", m[1])))
    return out


def value_after(before: list[str], word: str) -> tuple[str, str] | None:
    """(name, value) of a word that the words before it announce."""
    name = next((w for w in reversed(before) if not re.match(SIGN, w)), "")
    value = word.strip("\"'`").rstrip(",;)]}>\"'.")
    return (re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", name), value) if len(value) >= 6 else None


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), bound, left, right, share of secrets; the language that features were taken with."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    language: Language

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, bound, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= bound[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, smallest: int) -> tuple:
    nodes: list[list] = []

    def build(own: np.ndarray, level: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[own].mean())])
        if level == depth or len(own) < 2 * smallest or y[own].min() == y[own].max():
            return here
        best = None
        for f in rng.choice(x.shape[1], math.ceil(math.sqrt(x.shape[1])), replace=False):
            values = np.unique(np.quantile(x[own, f], np.linspace(0.05, 0.95, 19)))
            for bound in values:
                go = x[own, f] <= bound
                a, b = int(go.sum()), int((~go).sum())
                if min(a, b) < smallest:
                    continue
                p, q = y[own][go].mean(), y[own][~go].mean()
                impurity = a * p * (1 - p) + b * q * (1 - q)
                if best is None or impurity < best[0]:
                    best = (impurity, f, bound, go)
        if best is None:
            return here
        _, f, bound, go = best
        nodes[here][:2] = int(f), float(bound)
        nodes[here][2] = build(own[go], level + 1)
        nodes[here][3] = build(own[~go], level + 1)
        return here

    build(rng.integers(0, len(y), len(y)), 0)
    return tuple(np.array(c) for c in zip(*nodes, strict=True))


def fit(findings: list[tuple[str, str, str, str, str, int]], trees: int = 25, depth: int = 8, smallest: int = 3, seed: int = 5, language: Language | None = None) -> Forest:
    """Train on labelled findings (name, value, path, word before, word after, label)."""
    language = language or built_in()
    x = np.array([describe(*f[:5], language) for f in findings])
    y = np.array([f[5] for f in findings], dtype=np.float64)
    rng = np.random.default_rng(seed)
    return Forest([_tree(x, y, rng, depth, smallest) for _ in range(trees)], language)


def scan(docs: DataFrame, forest: Forest, path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, word_index, name, n_chars, value_sha256, score, is_secret.

    Every word of every whole text is looked at, however long it is; a block of a private key is one candidate, at
    its first word.  Values are returned as digests only.
    Null text has no candidates; repeated rows repeat theirs; rows without a doc_id are
    scanned too.  ``path`` names a column with the document's place (null: none);
    without one the path is empty.  Other columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, word_index long, name string, n_chars long, value_sha256 string, score double, is_secret boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.slices(whole):
                offsets, codes, distinct = base.coded_words(batch.column("text"))
                has = lambda p: np.asarray(pc.match_substring_regex(distinct, p), dtype=bool)  # noqa: E731, B023
                odd = has(ASSIGNED) | (has(RUN) & (has("[0-9]") | has(MIXED)))
                blocks = {(d, first): (end, key) for d in np.flatnonzero(np.asarray(pc.match_substring(batch.column("text"), "PRIVATE KEY"))).tolist() for first, end, key in blocks_in(batch.column("text")[d].as_py())}
                parts: dict[int, list[tuple[str, str]]] = {}
                for i in np.flatnonzero(odd).tolist():
                    if values := values_in(distinct[i].as_py()):
                        parts[i] = values
                good = np.zeros(len(distinct), dtype=bool)
                good[list(parts)] = True
                # The word after a cue, or after a cue and a sign, within the same text.
                cue, sign = has(CUE)[codes], has(SIGN)[codes]
                number = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                after = np.zeros(len(codes), dtype=bool)
                after[1:] = cue[:-1] & (number[1:] == number[:-1])
                after[2:] |= cue[:-2] & sign[1:-1] & (number[2:] == number[:-2])
                after &= ~good[codes] & ~sign & ~cue
                # The words of a block are no candidates by themselves.
                look = good[codes] | after
                for (d, first), (end, _) in blocks.items():
                    look[offsets[d] + first : offsets[d] + end] = False
                    look[offsets[d] + first] = True
                at = np.flatnonzero(look)
                if not len(at):
                    continue
                text = np.searchsorted(offsets, at, side="right") - 1
                paths = batch.column("path").to_pylist()
                rows, found = [], []
                for w, d in zip(at.tolist(), text.tolist(), strict=True):
                    words = [distinct[int(codes[j])].as_py() for j in range(max(int(offsets[d]), w - 2), w)]
                    follows = distinct[int(codes[w + 1])].as_py() if w + 1 < offsets[d + 1] else ""
                    told = value_after(words, distinct[int(codes[w])].as_py()) if after[w] else None
                    block = blocks.get((d, w - int(offsets[d])))
                    values = [("private key", block[1])] if block else [told] if told else parts.get(int(codes[w]), [])
                    for name, value in values:
                        rows.append(describe(name, value, paths[d] or "", " ".join(words), follows, forest.language))
                        found.append((d, w - int(offsets[d]), name, len(value), hashlib.sha256(value.encode()).hexdigest()))
                if not rows:
                    continue
                chance = forest.chance(np.array(rows))
                doc, index, name, size, sha = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(index, pa.int64()), pa.array(name), pa.array(size, pa.int64()), pa.array(sha), pa.array(chance), pa.array(chance >= threshold)], names=["doc_id", "word_index", "name", "n_chars", "value_sha256", "score", "is_secret"])

    where = (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), where, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(base.trimmed(run), schema)
