"""Toxicity: misspelled lexicon terms found by Levenshtein automata on a trie, weighed by their context.

The lexicon is learned from labelled rows: whole terms, and stems that occur with many endings, whose documents are
nearly all toxic.  A Levenshtein automaton, in which a swap of neighbours is one edit, walks the trie of the terms for a
token, its parts between marks and its look-alike spelling.  A window of tokens around a match tells quotation (quote marks
around it, a reporting word before it) from abuse; a logistic model weighs what a document holds of each.

Tokens of a slice of texts are hashed at once; a worker matches a token the first time it meets it and remembers hash and
outcome in two arrays, over all its tasks, so a known token costs a look-up and only texts with a match are read word by word.
"""
from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Scratch, chunks, is_blank, labelled_sample, mix, span_hashes, text_buffer, word_spans

SAMPLE_ROWS = 8_000
WINDOW = 8
#: With more remembered tokens than this a worker starts anew.
TOKENS = 4_000_000
DISGUISED = 0.9
#: Look-alike characters, quote marks, reporting words of the four languages.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
OPENING, CLOSING = "\"«“„‘'", "\"»”“’'"
REPORTING = frozenset("said says wrote called quote quoted quotes word words term writes says dit écrit mot mots citation sagte schrieb wort zitat zitiert dijo escribió palabra cita".split())
_TOKEN = re.compile(r"\S+")
_REPEAT = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[\W_]+")
_EDGE = ".,;:!?*#&%$\"'«»“”„‘’()[]{}<>|-_~`/\\=+^"


class Trie:
    """Terms with their kind: a word must match whole, a stem matches any token that begins with it."""

    def __init__(self, terms: dict[str, str]):
        self.root: dict = {}
        for term, kind in terms.items():
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = (term, kind)

    def search(self, token: str, most: int, swaps: bool = False) -> tuple[str, str, int] | None:
        """The nearest entry within `most` edits: (term, kind, edits); with `swaps` two neighbours in the wrong order are one edit.

        The automaton's state is a row of edit counts against the token, cut off above `most`; it advances along the
        trie's edges, so common beginnings of terms are matched once.  A stem takes the least count at any end of the
        token's beginning.
        """
        best = None
        n = len(token)
        stack = [(self.root, tuple(min(i, most + 1) for i in range(n + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    term, kind = child
                    edits = row[n] if kind == "word" else min(row)
                    if edits <= min(most, allowed_edits(term, kind)) and (best is None or (edits, term) < (best[2], best[0])):
                        best = (term, kind, edits)
                    continue
                new = [row[0] + 1]
                for i in range(n):
                    new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (token[i] != ch)))
                    if swaps and i and before and token[i] == last and token[i - 1] == ch:
                        new[-1] = min(new[-1], before[i - 1] + 1)
                if min(new) <= most:
                    stack.append((child, tuple(new), row, ch))
        return best


def allowed_edits(term: str, kind: str) -> int:
    """One edit from 4 characters on, two for words from 9 on; a stem is short and has one.  3 characters must match exactly."""
    return 0 if len(term) < 4 else 1 if kind == "stem" or len(term) < 9 else 2


class Pieces:
    """Which tokens can be within the allowed edits of a term: one of edits + 1 pieces of the term is intact, the first at the
    token's start, the last at its end, one between anywhere; lengths differ by the edits at most.  A stem's pieces lie in the
    token's beginning.  A swap over the border of two pieces breaks both, so the term with that swap has its pieces too."""

    def __init__(self, terms: dict[str, str]):
        self.starts: dict[int, dict[str, set[int]]] = {}
        self.ends: dict[int, dict[str, set[int]]] = {}
        self.inner: list[tuple[str, range]] = []
        self.stem_starts: dict[int, set[str]] = {}
        self.stem_inner: dict[tuple[int, int], set[str]] = {}
        self.most = max((allowed_edits(t, k) for t, k in terms.items()), default=0)
        for term, kind in terms.items():
            if not (k := allowed_edits(term, kind)):
                continue
            cuts = [i * len(term) // (k + 1) for i in range(k + 2)]
            lengths = range(len(term) - k, len(term) + k + 1)
            spellings = [term]
            for c in cuts[1:-1]:
                spellings += [t[:c - 1] + t[c] + t[c - 1] + t[c + 1:] for t in spellings]
            for own in dict.fromkeys(spellings):
                pieces = [own[i:j] for i, j in zip(cuts, cuts[1:])]
                if kind == "stem":
                    self.stem_starts.setdefault(len(pieces[0]), set()).add(pieces[0])
                    for at, piece in zip(cuts[1:], pieces[1:]):
                        for start in range(max(0, at - k), at + k + 1):
                            self.stem_inner.setdefault((start, start + len(piece)), set()).add(piece)
                    continue
                for table, piece in ((self.starts, pieces[0]), (self.ends, pieces[-1])):
                    table.setdefault(len(piece), {}).setdefault(piece, set()).update(lengths)
                self.inner += [(p, lengths) for p in pieces[1:-1]]
        self.inner = list(dict.fromkeys(self.inner))
        self.first, self.last = list(self.starts.items()), list(self.ends.items())
        self.stem_first, self.stem_rest = list(self.stem_starts.items()), list(self.stem_inner.items())
        self.lengths = {n for t in (self.starts, self.ends) for own in t.values() for ns in own.values() for n in ns}

    def may_match(self, token: str) -> bool:
        for k, own in self.stem_first:
            if token[:k] in own:
                return True
        for (i, j), own in self.stem_rest:
            if token[i:j] in own:
                return True
        n = len(token)
        if n not in self.lengths:
            return False
        for k, own in self.first:
            if n in own.get(token[:k], ()):
                return True
        for k, own in self.last:
            if n in own.get(token[-k:], ()):
                return True
        for piece, lengths in self.inner:
            if n in lengths and piece in token:
                return True
        return False


class Letters:
    """Which plain words can match a term at all, for many words at once.

    An edit adds one letter to a word, takes one out, or both; so a word within k edits of a term misses at most k of its
    letters and has at most k others, as sets and counted with repeats, and its length differs by k at most.  Letters fall
    into 32 classes.
    """

    def __init__(self, terms: dict[str, str], pieces: Pieces):
        self.terms, self.pieces = terms, pieces
        self.near = [(len(t), allowed_edits(t, k), self.sets([t])[0], self.counts([t])[0]) for t, k in terms.items() if k == "word" and allowed_edits(t, k)]
        self.stems = [(k, frozenset(t for t, kind in terms.items() if kind == "stem" and len(t) == k)) for k in sorted({len(t) for t, kind in terms.items() if kind == "stem"})]

    @staticmethod
    def sets(words: list[str]) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.bitwise_or.reduceat(np.uint32(1) << (codes & np.uint32(31)), np.cumsum(size) - size)

    @staticmethod
    def counts(words: list[str]) -> np.ndarray:
        """How often each class is in a word, as words x 32 (up to 127)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = np.bincount(np.repeat(np.arange(len(words)), size) * 32 + (codes & np.uint32(31)), minlength=32 * len(words))
        return np.minimum(flat, 127).astype(np.int8).reshape(-1, 32)

    def may_match(self, words: list[str]) -> np.ndarray:
        """words: not empty, letters only."""
        size, own = np.fromiter(map(len, words), np.int64, len(words)), self.sets(words)
        out = np.zeros(len(words), bool)
        longest = max((n + k for n, k, _, _ in self.near), default=0)
        short = np.flatnonzero(size <= longest)
        counts = np.zeros((len(words), 32), np.int8)
        if len(short):
            counts[short] = self.counts([words[i] for i in short.tolist()])
        for n, k, letters, term in self.near:
            at = np.flatnonzero(~out & (np.abs(size - n) <= k) & (np.bitwise_count(letters & ~own) <= k) & (np.bitwise_count(own & ~letters) <= k))
            gap = counts[at] - term
            out[at] = (np.maximum(gap, 0).sum(1) <= k) & (np.maximum(-gap, 0).sum(1) <= k)
        begins = [(0, k, t) for k, t in self.stems] + [(0, k, t) for k, t in self.pieces.stem_first] + [(i, j, t) for (i, j), t in self.pieces.stem_rest]
        return out | np.fromiter((w in self.terms or any(w[i:j] in t for i, j, t in begins) for w in words), bool, len(words))


@dataclass
class Matcher:
    terms: dict[str, str]
    exceptions: frozenset[str] = frozenset()
    most: int = 2
    cache: dict = field(default_factory=dict, repr=False)
    found: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.trie, self.pieces = Trie(self.terms), Pieces(self.terms)
        self.longest = max(map(len, self.terms), default=0) + 2 * self.most + 1
        stems = [t for t, k in self.terms.items() if k == "stem"]
        self.stems = [(k, frozenset(t for t in stems if len(t) == k)) for k in sorted({len(t) for t in stems})]

    def exact(self, word: str) -> str | None:
        if word in self.terms:
            return word
        for k, own in self.stems:
            if word[:k] in own:
                return word[:k]
        return None

    def token(self, raw: str) -> tuple[str, int] | None:
        """(term, 0 exact, 1 disguised or misspelled): the first of `hits`."""
        hits = self.hits(raw)
        return hits[0][1:] if hits else None

    def hits(self, raw: str) -> tuple[tuple[str, str, int], ...]:
        """(word, term, 0 exact or 1 disguised or misspelled): the token as a whole if it is a term as it stands, else its
        parts between inner marks, else the whole with its disguises."""
        if raw in self.cache:
            return self.cache[raw]
        if len(self.cache) > 50_000:
            self.cache.clear()
        plain = raw.casefold().strip(_EDGE)
        found = ()
        if len(plain) > 2 and (hit := self.exact(plain)) and plain.isalpha():
            found = ((plain, hit, 0),)
        elif len(plain) > 2:
            parts = [] if plain.isalpha() else [p for p in _INNER.split(plain) if p != plain]
            found = tuple((p, *h) for p in parts if len(p) > 2 and (h := self.word(p, p)))
            if not found and (h := self.word(plain, raw)):
                found = ((plain, *h),)
        self.cache[raw] = found
        return found

    def search(self, form: str) -> str | None:
        """The nearest term.  No word matches beyond the longest term and its edits, and of a stem's token only the beginning counts."""
        form = form[:self.longest]
        if form not in self.found:
            if len(self.found) > 50_000:
                self.found.clear()
            self.found[form] = (self.trie.search(form, min(self.most, self.pieces.most), True) or (None,))[0]
        return self.found[form]

    def word(self, plain: str, raw: str) -> tuple[str, int] | None:
        if hit := self.exact(plain):
            return hit, 0
        if plain in self.exceptions:
            return None
        simple = plain.isalpha() and not _REPEAT.search(plain)
        for form in (plain,) if simple else self.forms(plain, raw):
            hit = None if simple else self.exact(form)
            if not hit and self.pieces.may_match(form):
                hit = self.search(form)
            if hit:
                return hit, 1
        return None

    @staticmethod
    def forms(plain: str, raw: str) -> list[str]:
        """The token itself, without repeated letters, with look-alike characters as letters, without marks between letters."""
        out = [plain]
        if _REPEAT.search(plain):
            out.append(_REPEAT.sub(r"\1", plain))
        if not plain.isalpha():
            inner = raw.casefold().strip(".,;:?\"'«»“”„()[]{}<>").translate(LOOKALIKE)
            out += [plain.translate(LOOKALIKE), re.sub(r"\W", "", inner), re.sub(r"[\W_]", "", plain)]
        return list(dict.fromkeys(f for f in out if f))

    def features(self, text: str) -> np.ndarray:
        """How much abuse and how much quotation (log scale, and whether any), distinct terms of abuse, abuse per word.

        A disguised or misspelled match counts `DISGUISED` of a plain one, so what labelled documents tell of plain terms
        holds for spellings that they do not contain.
        """
        tokens = _TOKEN.findall(text)
        get, cache = self.hits, self.cache
        hits = [(i, h) for i, t in enumerate(tokens) if (h := cache[t] if t in cache else get(t))]
        abuse, quotes, terms = 0.0, 0.0, set()
        for i, own in hits:
            quoted = self.quoted(tokens, i)
            for _, term, kind in own:
                weight = DISGUISED if kind else 1.0
                if quoted:
                    quotes += weight
                else:
                    abuse += weight
                    terms.add(term)
        return np.array([np.log1p(abuse), min(abuse, 1.0), np.log1p(quotes), min(quotes, 1.0), np.log1p(len(terms)), 100 * abuse / max(20, len(tokens))])

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        """In the window: an opening mark at or before the match with no closing mark between, and a closing mark at or after
        it; or a reporting word among the four tokens before it and a quote mark on the match."""
        own = tokens[i]
        if own[0] in OPENING and own.rstrip(".,;:!?")[-1:] in CLOSING and len(own) > 2:
            return True
        opened = False
        for k in range(i, max(-1, i - WINDOW - 1), -1):
            t = tokens[k]
            if k < i and t.rstrip(".,;:!?")[-1:] in CLOSING:
                break
            if t[0] in OPENING:
                opened = True
                break
        if opened:
            return any(tokens[k].rstrip(".,;:!?")[-1:] in CLOSING for k in range(i, min(len(tokens), i + WINDOW + 1)))
        return any(t.casefold().strip(_EDGE) in REPORTING for t in tokens[max(0, i - 2):i]) and own[0] in OPENING


@dataclass
class ToxicityModel:
    matcher: Matcher
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.matcher.features(t) for t in texts]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


class TokenScan:
    """Which texts of a column have a match at all."""

    def __init__(self, matcher: Matcher):
        self.matcher, self.keys, self.hit = matcher, np.empty(0, np.uint64), np.empty(0, bool)
        self.letters = Letters(matcher.terms, matcher.pieces)

    def new_hits(self, tokens: list[str]) -> np.ndarray:
        """Plain words go through the letter sets first; all others are matched one by one."""
        words = [t.casefold().strip(_EDGE) for t in tokens]
        out = np.fromiter((len(w) > 2 for w in words), bool, len(words))
        plain = [i for i, w in enumerate(words) if out[i] and w.isalpha() and not _REPEAT.search(w)]
        if plain:
            out[plain] = self.letters.may_match([words[i] for i in plain])
        for i in np.flatnonzero(out).tolist():
            out[i] = self.any_hit(tokens[i])
        return out

    def any_hit(self, token: str) -> bool:
        """A run of bytes without ASCII white space may still hold other white space."""
        return any(self.matcher.hits(t) for t in _TOKEN.findall(token))

    def texts_with_hits(self, column: pa.Array) -> np.ndarray:
        data, offs = text_buffer(column)
        starts, ends, owner = word_spans(is_blank(data), offs)
        out = np.zeros(len(column), bool)
        if not len(starts):
            return out
        own, where, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > TOKENS:
            self.keys, self.hit = np.empty(0, np.uint64), np.empty(0, bool)
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        known = self.keys[at] == own if len(self.keys) else np.zeros(len(own), bool)
        hit = np.zeros(len(own), bool)
        hit[known] = self.hit[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            hit[new] = self.new_hits([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            place = np.searchsorted(self.keys, own[new])
            self.keys, self.hit = np.insert(self.keys, place, own[new]), np.insert(self.hit, place, hit[new])
        out[owner[hit[back]]] = True
        return out


#: The scan of the model in use, one per Python worker.
_scans: dict[str, TokenScan] = {}


def _words(text: str) -> set[str]:
    return {w for t in set(_TOKEN.findall(text)) if 3 < len(w := t.casefold().strip(_EDGE)) < 40}


def _entries(words: set[str]) -> set[str]:
    """Words, marked with =, and their beginnings of 4 to 8 characters."""
    return {"=" + w for w in words} | {w[:k] for w in words for k in range(4, min(9, len(w)))}


def learn_lexicon(documents: DataFrame, least: int = 5, precision: float = 0.9) -> dict[str, str]:
    """Terms and stems of a bounded table (text, y).

    An entry is in at least `least` toxic documents, near copies counted once, and these make `precision` of its documents.
    A beginning with several endings is a stem.
    """
    def entries(batches):
        for b in chunks(batches, "text", 1 << 20):
            rows = [(d, e) for d, t in zip(b.column("d").to_pylist(), b.column("text").to_pylist()) for e in _entries(_words(t))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([e for _, e in rows], pa.string())], names=["d", "entry"])

    documents = documents.dropDuplicates(["text"]).withColumn("d", F.xxhash64("text"))
    toxic = documents.where("y = 1").select("d", "text").mapInArrow(entries, "d long, entry string")
    some = {r["entry"]: r["n"] for r in toxic.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    cast = documents.sparkSession.sparkContext.broadcast(frozenset(some))

    def clean(batches):
        n = Counter()
        for b in chunks(batches, "text"):
            for t in b.column("text").to_pylist():
                n.update(_entries(_words(t)) & cast.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["entry", "n"])

    other = {r["entry"]: r["n"] for r in documents.where("y = 0").select("text").mapInArrow(clean, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    good = [e for e, n in some.items() if n >= precision * (n + other.get(e, 0))]
    keep = documents.sparkSession.sparkContext.broadcast(frozenset(good))

    def chosen(batches):
        for b in chunks(batches, "text", 1 << 20):
            rows = [(d, e) for d, t in zip(b.column("d").to_pylist(), b.column("text").to_pylist()) for e in _entries(_words(t)) & keep.value]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([e for _, e in rows], pa.string())], names=["d", "entry"])

    where: dict[str, set[int]] = {}
    for r in documents.where("y = 1").select("d", "text").mapInArrow(chosen, "d long, entry string").collect():
        where.setdefault(r["entry"], set()).add(r["d"])
    family = _families({r["d"]: r["sketch"] for r in documents.where("y = 1").select("d", "text").mapInArrow(_sketches, "d long, sketch array<long>").collect()})
    count = {e: len({family[d] for d in ds}) for e, ds in where.items()}
    count = {e: n for e, n in count.items() if n >= max(least, 0.005 * len(set(family.values())))}
    words = {e[1:]: n for e, n in count.items() if e[0] == "="}
    terms: dict[str, str] = {}
    for p in sorted((e for e in count if e[0] != "="), key=lambda e: (len(e), e)):
        if max((n for w, n in words.items() if w.startswith(p)), default=0) < 0.5 * count[p] and not any(p.startswith(q) for q in terms):
            terms[p] = "stem"
    return terms | {w: "word" for w in words if not any(w.startswith(q) for q in terms)}


def _sketches(batches):
    """For each text the least of its words' hashes under 12 mixings."""
    for b in chunks(batches, "text"):
        out = []
        for t in b.column("text").to_pylist():
            h = np.array([hash_word(w) for w in _words(t)] or [0], np.uint64)
            out.append([int(mix(h, k).min().view(np.int64)) for k in range(12)])
        yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(out, pa.list_(pa.int64()))], names=["d", "sketch"])


def hash_word(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))


def _families(sketches: dict[int, list[int]]) -> dict[int, int]:
    """Near copies count once: texts that agree in a band of 3 sketch values get one number."""
    seen: dict[tuple, int] = {}
    out = {}
    for d in sorted(sketches):
        keys = [(k, *sketches[d][k:k + 3]) for k in range(0, 12, 3)]
        out[d] = min((seen[k] for k in keys if k in seen), default=d)
        for k in keys:
            seen.setdefault(k, out[d])
    return out


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most `most_rows` labelled documents outside the held-out fold.  Without toxic ones every score is near 0."""
    sample = Scratch(docs.sparkSession).stage(labelled_sample(docs, labels, "toxic", most_rows), "sample")
    terms = learn_lexicon(sample)

    def near(batches):
        m, bad, seen, known = Matcher(terms), Counter(), Counter(), {}
        scan = TokenScan(m)
        for b in chunks(batches, "text"):
            own = [set(_TOKEN.findall(text)) for text in b.column("text").to_pylist()]
            fresh = list(set().union(*own) - known.keys())
            known |= zip(fresh, scan.new_hits(fresh).tolist())
            for tokens, y in zip(own, b.column("y").to_pylist()):
                for w in {w for t in tokens if known[t] for w, _, kind in m.hits(t) if kind}:
                    seen[w] += 1
                    bad[w] += y
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64()), pa.array([bad[w] for w in seen], pa.int64())], names=["w", "n", "bad"])

    # tokens near a term that occur in clean documents of the sample: at most as many as the bounded sample holds
    exceptions = [r["w"] for r in sample.mapInArrow(near, "w string, n long, bad long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("bad <= 0.5 * n").collect()]
    matcher = Matcher(terms, frozenset(exceptions))

    def features(batches):
        scan = TokenScan(matcher)
        for b in chunks(batches, "text"):
            found = scan.texts_with_hits(b.column("text"))
            x = np.array([matcher.features(t) if f else np.zeros(6) for t, f in zip(b.column("text").to_pylist(), found)])
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.mapInArrow(features, "y int, x array<double>").toPandas()
    x, y = np.array(got["x"].tolist()).reshape(-1, 6), got["y"].to_numpy(float)
    return ToxicityModel(matcher, *logistic(x, y))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), (-6.0 if not len(y) or y.max() == 0 else 6.0)
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of `docs` and score, over whole texts.

    Null and empty texts have no matches and get the model's base score.  Repeated rows are scored each; an existing
    column named score is replaced.
    """
    cast = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.matcher.terms, model.matcher.exceptions, model.weights, model.bias))
    docs = docs.drop("score")

    def run(batches):
        name, terms, exceptions, weights, bias = cast.value
        if name not in _scans:
            _scans.clear()
            _scans[name] = TokenScan(Matcher(terms, exceptions))
        scan = _scans[name]
        m = ToxicityModel(scan.matcher, weights, bias)
        plain = m.score([""])[0]  # every text without a match
        for b in chunks(batches, "text"):
            s = np.full(b.num_rows, plain)
            if len(found := np.flatnonzero(scan.texts_with_hits(b.column("text")))):
                s[found] = m.score(b.column("text").take(pa.array(found)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double")
