"""Garbled text from a wrong character encoding (problem 8).

Method: a multinomial classifier on hashed byte bigrams, trained on synthetically garbled records, predicts
for every word with signs outside ASCII the encoding chain that garbled it, or none; the chain is
inverted and must decode strictly, and the restored word must be likelier as right text than the garbled one.

A chain is (bytes' true encoding, encoding they were read with), once or twice.  Words are what white space
of ASCII separates, so a stretch inside an otherwise right text is found and restored on its own.  A
word that is nothing but the wrong signs between intact quotation marks is quoted, not garbled.  Chains that lose characters
(``LOSSY``: bytes that cannot be read become U+FFFD) are classes of the classifier too: a word with U+FFFD that one of them explains better
than right text marks its document, which is found but cannot be got back.

Fitting the classifier reads a bounded sample (at most about ``SAMPLE`` documents, by a hash of the key).  How often a word is met is
counted over all documents: a first pass over them, whole, adds up their words and keeps the few documents
with a word that some chain may explain; the counts of these words and of what the chains make of them are joined to
the document, and it is judged by them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread
from tidemark.session import cut

SAMPLE = 20_000
BUCKETS = 1 << 15
OFTEN = 40  # sightings in the sample that prove a word commoner than another that was not seen twice
PARTIAL = 1 << 17  # words a task counts before it hands them on

_SINGLE = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r")
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *[(("utf-8", w),) for w in _SINGLE],
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    *[(("cp1252", w),) for w in ("cp437", "cp850", "mac-roman", "cp1250", "cp1251", "koi8-r")],
    *[(("cp1250", w),) for w in ("cp1252", "latin-1", "cp437", "cp850", "mac-roman")],
    *[(("iso8859-2", w),) for w in ("cp1252", "latin-1", "cp437", "cp850")],
    *[(("mac-roman", w),) for w in ("cp1252", "latin-1", "cp850")],
    *[(("cp850", w),) for w in ("cp1252", "latin-1", "mac-roman")],
    *[(("cp437", w),) for w in ("cp1252", "latin-1")],
]

#: (true encoding, the one it was read with), unreadable bytes becoming U+FFFD.
LOSSY = [*[(true, "utf-8") for true in ("cp1252", "cp1250", "iso8859-2", "mac-roman", "cp850", "cp1251", "koi8-r")], ("utf-8", "ascii"), ("utf-8", "cp1252"), ("utf-8", "cp1250")]


def _table(codec: str) -> str:
    """What each byte reads as; undefined bytes read as the control of the same number, as browsers do."""
    return "".join(bytes([i]).decode(codec, "ignore") or chr(i) for i in range(256))


_READ = {c: _table(c) for c in {w for chain in CHAINS for pair in chain for w in pair} - {"utf-8"}}
_BYTE = {c: {ch: i for i, ch in reversed(list(enumerate(t)))} for c, t in _READ.items()}


def _encode(text: str, codec: str) -> bytes | None:
    if codec == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    table = _BYTE[codec]
    got = [table.get(ch, -1) for ch in text]
    return None if -1 in got else bytes(got)


def _decode(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode("utf-8") if codec == "utf-8" else raw.decode("latin-1").translate(_READ[codec])
    except UnicodeDecodeError:
        return None


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` as the chain spoils it; None where its true encoding has no such characters."""
    for true, wrong in chain:
        raw = _encode(text, true)
        if raw is None:
            return None
        text = _decode(raw, wrong)
    return text


def spoil(text: str, lossy: tuple[str, str]) -> str | None:
    """``text`` as a lossy chain leaves it; None where that loses nothing or its true encoding has no such characters."""
    try:
        bad = text.encode(lossy[0]).decode(lossy[1], "replace")
    except UnicodeEncodeError:
        return None
    return bad if _LOST in bad else None


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The chain inverted, or None where that is not strictly possible."""
    for true, wrong in reversed(chain):
        raw = _encode(text, wrong)
        text = None if raw is None else _decode(raw, true)
        if text is None:
            return None
    return text


def bigrams(word: str) -> np.ndarray:
    """Hash buckets of the byte bigrams of a word with a blank on either side."""
    b = np.frombuffer(f" {word} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((b[:-1] * 256 + b[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


_WORDS = re.compile(r"[^ \t\r\n\f\v]+")
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_QUOTES = "«»“”„‘’‚‹›\"'"
_LOST = "�"


@dataclass
class Judge:
    """The fitted classifier: ``weight[class, bucket]`` log-probabilities, class 0 right text, then the chains, then the lossy ones.

    ``known`` counts documents by word: a word met oftener than what a chain would make of it is right text,
    whatever its signs.  It needs no more than the words of ``lookups`` for each word judged.
    """

    weight: np.ndarray
    known: dict[str, int]
    prior: float = 4.0
    gain: float = 1.0
    memo: dict = field(default_factory=dict)
    asked: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_bucket = np.ascontiguousarray(self.weight.T)  # a word reads whole rows

    def met(self, word: str) -> int:
        return self.known.get(_core(word), 0)

    def word(self, word: str) -> tuple[int, str, bool] | None:
        """(chain number, restored word, is it sure) of a garbled word, else None."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 1 << 18:
            self.memo.clear()
        got = self._word(word)
        if len(word) <= 64:
            self.memo[word] = got
        return got

    def lost(self, word: str) -> int:
        """Characters lost in a word: its U+FFFD, if a lossy chain explains it as well as right text or better."""
        if _LOST not in word:
            return 0
        every = self.by_bucket[bigrams(word)].sum(axis=0)
        return word.count(_LOST) if every[1 + len(CHAINS) :].max() >= every[0] else 0

    def _word(self, word: str, chains: list[int] | None = None) -> tuple[int, str, bool] | None:
        at = bigrams(word)
        every = self.by_bucket[at].sum(axis=0)
        right, score = every[0], every[1 : 1 + len(CHAINS)]
        if chains is None:
            chains = range(len(CHAINS))
        else:
            score = score[chains]
        met = self.met(word)
        for i in np.argsort(-score, kind="stable").tolist():
            if score[i] < right:
                break
            c = int(chains[i])
            back = _back(word, c)
            if back is None:
                continue
            again = self.met(back)
            if met >= 3 and again <= met:
                continue
            if score[i] < right + (self.prior if again < 2 else 0):
                continue
            after = self.by_bucket[bigrams(back), 0].sum()
            # per bigram, since a chain may lengthen the word
            if again < 2 and after / (len(back.encode()) + 1) <= right / len(at) + self.gain and after <= right + 4 * self.gain:
                continue
            return c, back, _is_strict(c) or (_lettered(word) and again >= 2)
        return None

    def lookups(self, word: str) -> tuple[list[str], bool]:
        """The words whose counts decide on a word, itself and what the chains that score as right text or better make
        of it (none where no chain does, since no count can then make the word a garbled one), and whether it can be sure.

        A word met ``OFTEN`` times in the random sample and what a chain makes of it never, or once: were that the
        commoner one in all documents, the chance of such a sample would be below 2 ** -30, so the chain is left out.
        """
        if word in self.asked:
            return self.asked[word]
        every = self.by_bucket[bigrams(word)].sum(axis=0)
        often = self.met(word) >= OFTEN
        backs = {c: b for c in np.flatnonzero(every[1 : 1 + len(CHAINS)] >= every[0]).tolist() if (b := _back(word, c)) is not None and not (often and not self.met(b))}
        sure = any(_is_strict(c) for c in backs) or (bool(backs) and _lettered(word))
        got = list(dict.fromkeys(_core(w) for w in (word, *backs.values()))) if backs else [], sure
        if len(self.asked) > 1 << 18:
            self.asked.clear()
        if len(word) <= 64:
            self.asked[word] = got
        return got

    def quoted(self, text: str, start: int, end: int) -> bool:
        """Is the word at ``start:end`` only wrong signs between intact quotation marks?"""
        core = text[start:end].strip(".,;:!?()")
        inner = core.strip(_QUOTES + "\xa0")
        if any(ch.isascii() and ch.isalnum() for ch in inner):
            return False
        if inner != core:
            return core[:1] in _QUOTES and core[-1:] in _QUOTES
        before, after = text[max(0, start - 2) : start].strip(), text[end : end + 2].strip()
        return before[-1:] in tuple(_QUOTES) and after[:1] in tuple(_QUOTES)

    def text(self, text: str) -> tuple[list[tuple[int, int, int, str]], int]:
        """``(start, end, chain, restored)`` of the garbled words, and the number of lost characters.

        Nothing is found without a sure word.  With one, the chains of the sure words are tried first on every other
        word outside ASCII, and words that only an unrelated one-byte chain would explain are left alone.
        """
        words = [m.span() for m in _WORDS.finditer(text) if not m.group().isascii()]
        lost = sum(self.lost(text[a:z]) for a, z in words if not self.quoted(text, a, z)) if _LOST in text else 0
        got = [None if (g := self.word(text[a:z])) and self.quoted(text, a, z) else g for a, z in words]
        sure = Counter(g[0] for g in got if g and g[2])
        if not sure:
            return [], lost
        main = [c for c, _ in sure.most_common()]
        found = []
        for (a, z), g in zip(words, got):
            w = text[a:z]
            if g is None or not g[2]:
                g = None if self.quoted(text, a, z) else self._word(w, main)
            if g:
                found.append((a, z, g[0], g[1]))
        return found, lost


def _core(word: str) -> str:
    """A word without the marks at its ends; a word without letters or digits of ASCII as it is."""
    core = _EDGE.sub("", word)
    return core if any(ch.isascii() and ch.isalnum() for ch in core) else word


_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def _back(word: str, chain: int) -> str | None:
    """What the chain makes of the word, None where that cannot be right text."""
    back = restore(word, CHAINS[chain])
    return None if back is None or back == word or _LOST in back or any("\x80" <= ch <= "\x9f" for ch in back) else back


def _lettered(word: str) -> bool:
    return any(ch.isascii() and ch.isalpha() for ch in word)


def _is_strict(chain: int) -> bool:
    return CHAINS[chain][0][0] == "utf-8"


def affected(found: list[tuple[int, int, int, str]], lost: int) -> bool:
    """A document is affected if words were found garbled or characters were lost."""
    return bool(lost) or bool(found)


def fit(texts: list[str]) -> Judge:
    """Train on the sample's words outside ASCII: as they are for right text, garbled by each chain for the others.

    The sample itself holds garbled records; a first classifier finds them and the second is trained without.
    """
    docs = [{w for w in _WORDS.findall(t) if not w.isascii() and len(w) <= 64} for t in texts]
    # what each class sees of each word, worked out once: its buckets laid end to end, class by class
    words = sorted({w for d in docs for w in d if _LOST not in w})
    number = {w: i for i, w in enumerate(words)}
    seen = [_seen(words, None), *(_seen(words, lambda w, c=c: garble(w, c)) for c in CHAINS), *(_seen(words, lambda w, c=c: spoil(w, c)) for c in LOSSY)]
    judge = None
    for _ in range(2):
        if judge is not None:
            docs = [d for t, d in zip(texts, docs) if not affected(*judge.text(t))]
        met = np.bincount([number[w] for d in docs for w in d if w in number], minlength=len(words)) if words else np.zeros(0, np.int64)
        v = np.where(met > 0, 1.0 + np.log(np.maximum(met, 1)), 0.0)
        weight = np.stack([np.bincount(buckets, weights=v[owner], minlength=BUCKETS) for owner, buckets in seen])
        total = weight.sum(axis=1, keepdims=True)
        scaled = weight / np.maximum(total, 1) * 200_000
        known = Counter(c for d in docs for c in {_core(w) for w in d})
        common = {w: n for w, n in known.items() if w and n >= 2}
        judge = Judge(np.log((scaled + 0.2) / (200_000 + 0.2 * BUCKETS)).astype(np.float32), common)
    return judge


def _seen(words: list[str], spoiled) -> tuple[np.ndarray, np.ndarray]:
    """``(word number, bucket)`` of the words as a chain leaves them, without those it cannot or does not change; of the words themselves
    without a chain."""
    owners, parts = [], []
    for i, w in enumerate(words):
        bad = w if spoiled is None else spoiled(w)
        if bad is not None and (spoiled is None or bad != w):
            b = bigrams(bad)
            owners.append(np.full(len(b), i))
            parts.append(b)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(parts).astype(np.int64)


def judge_for(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Judge:
    """Fit on those of about ``sample`` documents, drawn by a hash of the key, that hold signs outside ASCII."""
    src = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = src.count()  # from the files' footers
    grain = 1 << 20
    keep = min(grain, -(-grain * sample // max(rows, 1)))
    drawn = src.where(F.pmod(F.xxhash64("k", F.lit("garble")), F.lit(grain)) < keep)
    picked = drawn.where(F.col("t").rlike(r"[^\x00-\x7f]")).limit(2 * sample).toArrow()
    order = np.argsort(picked.column(0).to_numpy(), kind="stable")
    return fit([picked.column(1)[int(i)].as_py() for i in order])


def garbled_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, whole: bool = True) -> DataFrame:
    """``(key, chains string, lost long, restored string)`` of the affected documents.

    ``chains`` names the chains found, most frequent first; ``restored`` is the text with every garbled word put
    right (null where characters were lost for good, or with ``whole`` off).  Null and empty texts and
    texts of ASCII are never affected.
    """
    fitted = judge_for(documents, key, text, sample)
    spark = documents.sparkSession
    first = spark.sparkContext.broadcast((fitted.weight, fitted.known))
    weight = spark.sparkContext.broadcast(fitted.weight)
    kind = f"`{key}` {documents.schema[key].dataType.simpleString()}"
    names = ["+".join(f"{t}>{w}" for t, w in chain) for chain in CHAINS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two sorts: documents some count may show to be affected, with the words to look up, and words of the
        documents that the sample's judge leaves alone, with the number of these."""
        j = Judge(*first.value)
        met: Counter = Counter()

        def rows(keys: pa.Array, texts: list, asked: list, words: list, n: list) -> pa.RecordBatch:
            none = len(words)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([keys, pa.nulls(none, keys.type)]), pa.array(texts + [None] * none, pa.string()), pa.array(asked + [None] * none, pa.list_(pa.string())),
                    pa.array([None] * len(texts) + words, pa.string()), pa.array([None] * len(texts) + n, pa.int64()),
                ],
                names=[key, "text", "asked", "word", "n"],
            )

        none = None
        for b in batches:
            none = b.column(0).slice(0, 0)
            at, texts, asked = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                words = {w for w in _WORDS.findall(t) if not w.isascii()}
                needs = [j.lookups(w) for w in words]
                look = {c for cores, _ in needs for c in cores} if any(sure for _, sure in needs) else set()
                if look or _LOST in t:
                    at.append(i)
                    texts.append(t)
                    asked.append(sorted(look))
                if not look or not affected(*j.text(t)):
                    met.update({_core(w) for w in words})
            many = len(met) > PARTIAL
            yield rows(b.column(0).take(pa.array(at, pa.int64())), texts, asked, list(met.keys()) if many else [], list(met.values()) if many else [])
            if many:
                met.clear()
        if met:
            yield rows(none, [], [], list(met.keys()), list(met.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(weight.value, {})
        for b in batches:
            keys, chains, losses, texts = [], [], [], []
            for k, t, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                j.known = {x["word"]: x["n"] for x in known or ()}
                found, lost = j.text(t)
                if not affected(found, lost):
                    continue
                keys.append(k)
                chains.append(",".join(names[c] for c, _ in Counter(c for _, _, c, _ in found).most_common()))
                losses.append(lost)
                back = None
                if whole and not lost:
                    at, pieces = 0, []
                    for a, z, _, r in found:
                        pieces += [t[at:a], r]
                        at = z
                    back = "".join([*pieces, t[at:]])
                texts.append(back)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.schema.field(0).type), pa.array(chains, pa.string()), pa.array(losses, pa.int64()), pa.array(texts, pa.string())], names=[key, "chains", "lost", "restored"]
            )

    cols = spread(documents.select(key, F.col(text).alias("text")))
    both = cut(cols.mapInArrow(read, f"{kind}, text string, asked array<string>, word string, n long"))
    # keys repeat and may be null, so the rows are numbered; written before, so numbered alike each time
    maybe = cut(both.where("asked IS NOT NULL").select(F.monotonically_increasing_id().alias("__row"), key, "text", "asked"))
    asked = maybe.select("__row", F.explode("asked").alias("word"))
    met = both.where("word IS NOT NULL").select("word", "n").join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    known = asked.join(met, "word").groupBy("__row").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return maybe.select("__row", key, "text").join(known, "__row", "left").select(key, "text", "known").mapInArrow(run, f"{kind}, chains string, lost long, restored string")
