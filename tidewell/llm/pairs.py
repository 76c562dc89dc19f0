"""Broken prompt and response pairs: empty, copied, refusing, truncated or in another language.

Language: a naive Bayes over character n-grams gives the posteriors of prompt and response; they are compared
where the response is a sentence, without the names it shares with the prompt. The languages are those of the
labelled texts and one more class for all languages without labelled texts, in which nearly all words are new to the
prompt's language; which and how many words of its own responses are new is learned from responses. All labelled texts and
all responses are counted. The model's n-grams and words are hashed into a fixed number of buckets, so it has a proven size
and may be broadcast. A prompt whose own language is unclear (mostly names) decides nothing.

Truncation: the likelihood that a text ends after its last words, from the ends of all responses, with back-off from
three words to two and one. A response without a final stop is whole if the same wording ends with a stop elsewhere
or its last words end texts at least as often as they go on; one of a few words is a bare value unless it is how
longer responses begin.

Defined results: a null response is empty; a null or unknown prompt leaves only empty, refusal and truncated to
be found; one defect per response, in the order empty, copy, refusal, truncated, other language; repeated rows
give one row; texts are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut

BUCKETS, WORDS = 1 << 16, 1 << 22
PER = 1000  # counts of a language with more texts are taken as a rate per so many, so that the model does not change with the size of the tables

# How responses decline; sentences that go on to answer do not use these forms.
REFUSAL = re.compile(
    r"insufficient[_ ]context|\b(i am|i'm|we are|we're) (sorry,? (but )?(i|we) )?(not able|unable)\b|\b(i|we) (can't|cannot|can not|could not|couldn't|don't know|do not know|do not have|don't have|have no (data|information|answer)|must decline|have to decline|won't|decline)\b"
    r"|\bno answer can be given\b|\bnot possible for me\b|\bit is not possible to (say|answer|tell)\b|(답변|답|대답)[^.]{0,12}(어렵|없|불가)|모르겠|알 수 없습니다|확인할 수 없|알려 ?드릴 수 없|(제공|말씀드릴|답변드릴) 수 없|정보가 (없|부족)[^.]*(습니다|어요)\s*[.]?$", re.I)  # fmt: skip
# Letters of which a text of only `_EVEN` letters that declines holds one at least; other letters may be the same as these but for their case.
DECLINES = ("able", "i ", "we ", "insufficient", "no answer can", "not possible", "없", "어렵", "불가", "모르겠", "부족")
LEADS = re.compile(r"^\s*(answer|question|you asked|q|a|prompt|the question (is|was)|답변|답|질문|질문하신 내용|question asked)\s*[:：]\s*", re.I)
OPEN_ENDS = re.compile(r"(\b(e\.g|i\.e|vs|prof|dr|mr|mrs|ms|st|no|approx|cf|ca|pp?|vol|fig|gen|sen|rev)\.|[,;:(\[{–-])\s*$", re.I)
STOPS, CLOSERS = (".", "!", "?", "。", "！", "？"), "'\"”’)]"
CLOSED_KO = re.compile(r"[가-힣](다|요|까|음|함|임|죠)$")
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтАВЕКМНОРСТХ", "aeopcyxijsdhkmtABEKMHOPCTX")
_EVEN = re.compile(r"[\x00-\x7f가-힣]*").fullmatch  # Unicode forms leave these as they are
_HANGUL = re.compile("[가-힣]").search
_LETTERS = re.compile(r"[^\W\d_]+").findall
_SAID = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?").findall
_TAGS, _BRACKETS, _ODD = re.compile(r"<[^<>]{0,200}>"), re.compile(r"\([^()]*\)"), re.compile(r"[\W_]+")
_HIDDEN = re.compile(r"[​-‏⁠﻿­]")
_TALK = re.compile(r"\b(answer|you asked)\b\W*")
_INTRO = re.compile(r".{0,12}[:：]\s")
_MARKS = re.compile(r"(\s*(\.\.\.|…))+$")
_FIVE = re.compile(r"(?:[\W_]*[^\W_]){5}").match


@lru_cache(maxsize=20_000)
def plain(text: str | None) -> str:
    """Unicode forms, tags, entities, invisible characters and look-alike letters made even."""
    s = unicodedata.normalize("NFKC", text or "")
    s = html.unescape(s)
    if "<" in s:
        s = _TAGS.sub(" ", s)
    return s if _EVEN(s) else _HIDDEN.sub("", s).translate(LOOKALIKES)


@lru_cache(maxsize=20_000)
def bare(text: str | None) -> str:
    s = plain(text)
    if _EVEN(s):
        return s.lower()
    s = unicodedata.normalize("NFKD", s).casefold()
    return unicodedata.normalize("NFC", "".join(c for c in s if not unicodedata.combining(c)))


def _word_grams(word: str) -> list[int]:
    """Buckets of the n-grams of one casefolded word, and of the word itself if it is short or ASCII."""
    w = f" {word} "
    if w.isascii():
        b = w.encode()
        out = [zlib.crc32(b[i : i + n]) % BUCKETS for n in (2, 3) for i in range(len(b) - n + 1)]
        out.append(zlib.crc32(b"=" + b) % BUCKETS)
        return out
    out = [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (2, 3) for i in range(len(w) - n + 1)]
    if len(w) < 7:
        out.append(zlib.crc32(("=" + w).encode()) % BUCKETS)
    return out


def _grams(text: str) -> list[int]:
    return [g for w in _LETTERS(text.casefold()) for g in _word_grams(w)]


@lru_cache(maxsize=100_000)
def _word(word: str) -> int:
    """Bucket of a word; of a Korean word the last two syllables count."""
    if not word.isascii() and _HANGUL(word):
        word = word[-2:]
    return zlib.crc32(word.casefold().encode()) % WORDS


class _Numbered(dict):
    """Numbers for keys in the order in which they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class _Lists:
    """Lists of numbers, one after the other."""

    def __init__(self):
        self.flat, self.sizes = array("q"), array("q")

    def add(self, numbers: Iterable[int]) -> None:
        before = len(self.flat)
        self.flat.extend(numbers)
        self.sizes.append(len(self.flat) - before)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all ``rows`` in order, and at which of the rows each stands."""
        flat, sizes = np.array(self.flat, np.int64), np.array(self.sizes, np.int64)
        n = sizes[rows]
        at = np.repeat(np.arange(len(rows)), n)
        return flat[np.repeat((sizes.cumsum() - sizes)[rows] - (n.cumsum() - n), n) + np.arange(len(at))], at


class _Tokens(_Numbered):
    """Numbered tokens with their casefolded words (for n-grams) and the buckets of their words, both numbered too; a
    capitalised token (mostly a name) has none."""

    def __init__(self):
        self.words, self.buckets, self.spelled, self.meant = _Numbered(), _Numbered(), _Lists(), _Lists()

    def __missing__(self, token: str) -> int:
        said = [] if token[:1].isupper() else _LETTERS(token)
        self.meant.add([self.buckets[_word(w)] for w in said])
        self.spelled.add([self.words[w] for w in (map(str.lower, said) if token.isascii() else [] if token[:1].isupper() else _LETTERS(token.casefold()))])
        return super().__missing__(token)


def _counted(batches: Iterator[pd.DataFrame], *, held: int = 300_000, at_once: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Per language the occurrences of n-grams, the texts with a word (from BUCKETS on) and all texts (-1), in partial sums
    of at most about ``held`` distinct tokens; about ``at_once`` letters are split into tokens at a time."""
    known, tokens, found, texts, waiting = _Tokens(), {}, {}, Counter(), defaultdict(list)

    def grow(sums: dict[str, np.ndarray], lang: str, n: np.ndarray) -> None:
        n[: len(sums.get(lang, ()))] += sums.get(lang, 0)
        sums[lang] = n

    def count() -> None:
        for lang, said in waiting.items():
            texts[lang] += len(said)
            split = pc.utf8_split_whitespace(pa.array(said, pa.large_string()))  # at what str.split takes for a space
            told = split.flatten().dictionary_encode()
            of, ids = np.array([known[t] for t in told.dictionary.to_pylist()], np.int64), told.indices.to_numpy()
            often = np.zeros(len(known), np.int64)
            often[of] = np.bincount(ids, minlength=len(of))
            grow(tokens, lang, often)
            word, at = known.meant.of(of[ids])
            words = max(1, len(known.buckets))
            each = np.sort(np.repeat(np.arange(len(said)), pc.list_value_length(split).to_numpy())[at] * words + word)
            grow(found, lang, np.bincount(each[np.diff(each, prepend=-1) > 0] % words, minlength=words))
        waiting.clear()

    def sums() -> Iterator[pd.DataFrame]:
        grams, buckets = _Lists(), np.fromiter(known.buckets, np.int64, len(known.buckets))
        for w in known.words:
            grams.add(_word_grams(w))
        for lang, n in texts.items():
            used = np.flatnonzero(tokens[lang])
            word, at = known.spelled.of(used)
            often = np.bincount(word, tokens[lang][used][at], len(known.words))
            gram, at = grams.of(np.arange(len(often)))
            often = np.bincount(gram, often[at], BUCKETS)
            yield pd.DataFrame({"lang": lang, "gram": [-1], "n": [n]})
            met = np.flatnonzero(found[lang])
            for gram, n in ((np.flatnonzero(often), often[often > 0]), (buckets[met] + BUCKETS, found[lang][met])):
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n.astype(np.int64)})

    letters = 0
    for b in batches:
        for i, (lang, text) in enumerate(zip(b.lang, b.text), 1):
            waiting[lang].append(text)
            letters += len(text)
            if letters > at_once or i == len(b):
                count()
                letters = 0
                if len(known) > held:
                    yield from sums()
                    known, tokens, found, texts = _Tokens(), {}, {}, Counter()
    yield from sums()


class LanguageModel:
    """Naive Bayes over hashed character n-grams; all labelled texts are counted on Spark."""

    def __init__(self, labelled: DataFrame):
        held = labelled.select("lang", "text").where("lang is not null and text is not null")
        counts = cut(held.mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
        texts = {r["lang"]: r["n"] for r in counts.where("gram = -1").collect()}  # a row a language
        self.langs = sorted(texts)
        table, self.seen = np.zeros((len(self.langs), BUCKETS)), np.zeros((len(self.langs), WORDS), dtype=bool)
        for i, lang in enumerate(self.langs):
            of = counts.where(F.col("lang") == lang)
            grams = of.where(F.col("gram").between(0, BUCKETS - 1)).select("gram", "n").toPandas()  # at most BUCKETS rows
            table[i, grams.gram] = grams.n * min(1.0, PER / texts[lang])
            # once may be a slip, and so may once in PER texts; at most WORDS rows
            self.seen[i, of.where((F.col("gram") >= BUCKETS) & (F.col("n") > 1) & (F.col("n") * PER > texts[lang])).select(F.col("gram") - BUCKETS).toPandas().iloc[:, 0].to_numpy(np.int64)] = True
        # A gram's presence counts, not how often texts repeat it: counts are damped.
        table = np.log1p(table)
        share = table / np.maximum(table.sum(1, keepdims=True), 1.0)
        self.log_p = np.log(0.9 * share + 0.1 / BUCKETS)  # what is unseen tells nothing, however many texts a language has
        self.new = np.full(len(self.langs), 0.5)

    def learn_new(self, read: DataFrame) -> None:
        """How often words of responses are new to their prompt's language, from all responses (``own``, ``total``, ``fresh``, ``often`` of `defects`).

        A word that labelled texts lack is not new if it mostly stands in responses that are familiar otherwise.
        """
        familiar = F.expr("(total - aggregate(often, 0, (a, x) -> a + x)) * 1000000L div total")  # in millionths, so that sums are exact
        held = read.where("total > 0").select("own", "total", "fresh", "often", familiar.alias("familiar"))
        of = {r["own"]: r for r in held.groupBy("own").agg(F.avg("familiar").alias("mean"), F.sum("total").alias("total")).collect()}  # a row a language
        if not of:
            return
        bar = F.array(*[F.lit(0.5 * of[i]["mean"] if i in of else 0.0) for i in range(len(self.langs))])[F.col("own")]
        good = ((F.col("familiar") >= bar) & (F.col("familiar") > 0)).alias("good")
        each = held.select("own", good, F.explode(F.arrays_zip("fresh", "often")).alias("x"))
        met = cut(each.groupBy("own", F.col("x.fresh").alias("word")).agg((F.count_if("good") > F.count_if(~F.col("good"))).alias("familiar"), F.sum("x.often").alias("n")), "met")
        known = met.where("familiar").select("own", "word").toPandas()  # at most labels x WORDS rows
        self.seen[known.own.to_numpy(np.int64), known.word.to_numpy(np.int64)] = True
        new = {r["own"]: r["n"] for r in met.where("not familiar").groupBy("own").agg(F.sum("n").alias("n")).collect()}
        for i, r in of.items():
            self.new[i] = np.clip((new.get(i, 0) + 1) / (r["total"] + 2), 0.01, 0.8)

    def unseen(self, new: np.ndarray, total: np.ndarray, lang: np.ndarray, *, foreign: float = 0.95, prior: float = 0.02) -> np.ndarray:
        """Posterior that ``total`` words, of which ``new`` are new, are of a language without labelled texts, against ``lang``."""
        u = self.new[lang]
        odds = np.log(prior / (1 - prior)) + new * np.log(foreign / u) + (total - new) * np.log((1 - foreign) / (1 - u))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def _numbered(self, words: Iterable[str]) -> list[int]:
        """Numbers of the words in ``_scored``, the log-likelihoods of their n-grams in each language."""
        out = []
        for w in words:
            i = self._kept.get(w)
            if i is None:
                i = self._kept[w] = len(self._kept)
                if i >= len(self._scored):
                    self._scored = np.concatenate([self._scored, np.zeros_like(self._scored)])
                g = _grams(w)
                self._scored[i] = self.log_p[:, g].mean(1) * len(g) if g else 0.0
            out.append(i)
        return out

    def posteriors(self, texts: list[Iterable[str]]) -> np.ndarray:
        """A row a text (its words); words recur, so the scores of a bounded number are kept from one call to the next."""
        if len(self.__dict__.setdefault("_kept", {})) > 100_000 or "_scored" not in self.__dict__:
            self._kept, self._scored = {}, np.zeros((1024, len(self.langs)))
        of = [self._numbered(words) for words in texts]
        word, at = np.array([i for x in of for i in x], np.int64), np.repeat(np.arange(len(of)), [len(x) for x in of])
        s = np.stack([np.bincount(at, self._scored[word, i], len(of)) for i in range(len(self.langs))], 1)
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_kept", "_scored")}


def _threes(s: str) -> frozenset[str]:
    return frozenset([s[i : i + 3] for i in range(max(1, len(s) - 2))]) if s else frozenset()


def _without_lead(s: str) -> str:
    lead = LEADS.match(s)
    return s[lead.end() :] if lead else s


def _is_copy(q: str, a: str) -> bool:
    parts, asked = _without_lead(bare(a)), bare(q)
    intro = _INTRO.match(parts)
    parts = parts[intro.end() :] if intro else parts
    said = _TALK.sub("", parts) if "answer" in parts or "you asked" in parts else parts
    said, put = _ODD.sub(" ", said).strip(), _ODD.sub(" ", _without_lead(asked)).strip()
    # More than a fifth of its letter threes are not the question's: told before all threes are gathered.
    most, missing = len(said) - 2, set()
    for i in range(most):
        if (t := said[i : i + 3]) not in put:
            missing.add(t)
            if 5 * len(missing) > most:
                return False
    x, y = _threes(put), _threes(said)
    if not y or len(y) > len(x) / 0.8 or len(y) < 0.7 * len(x):  # what the two shares below ask of the sizes
        return False
    both = len(x & y)
    if both < 0.8 * len(y) or both < 0.7 * len(x):
        return False
    asked = set(re.findall(r"\w+", asked))
    new = {w for w in re.findall(r"\w+", parts) if w not in asked and len(w) > 2 and w not in _SMALL}
    return not any(max((SequenceMatcher(None, w, v).ratio() for v in asked), default=0.0) < 0.7 for w in new)


def _sentence_words(q: str, a: str) -> list[str]:
    """Words of the response without names, numbers and what stands in brackets."""
    said = plain(a)
    words = _SAID(_BRACKETS.sub(" ", said) if "(" in said else said)
    asked = set(_LETTERS(bare(q)))
    return [w for i, w in enumerate(words) if not (i > 0 and w[:1].isupper()) and (w.lower() if w.isascii() else bare(w)) not in asked]


def _is_sentence(words: list[str]) -> bool:
    if len(words) >= 4:
        return True
    hangul = [w for w in words if _HANGUL(w)]
    return len(hangul) >= 2 and len(hangul[-1]) >= 3 and bool(CLOSED_KO.search(hangul[-1]))


def _languages(pairs: Iterable[tuple[str | None, str | None]], model: LanguageModel) -> pd.DataFrame:
    """Of each pair the prompt's language (-1: nothing is decided), whether the response is in another labelled one, and of a
    response of four words on their number and those that labelled texts of the prompt's language lack, with their counts."""
    said = [_sentence_words(q, a) if q and a else [] for q, a in pairs]
    out = pd.DataFrame({"own": -1, "other": False, "total": 0, "fresh": [[]] * len(said), "often": [[]] * len(said)})
    told = [i for i, words in enumerate(said) if _is_sentence(words)] if model.langs else []
    if not told:
        return out
    asked = model.posteriors([[w for w in _LETTERS(plain(pairs[i][0])) if not w[:1].isupper() or w.lower() in _ASKING] for i in told])
    clear = asked.max(1) > 0.9
    told, own = np.array(told)[clear], asked.argmax(1)[clear]
    heard = model.posteriors([said[i] for i in told]) if len(told) else np.zeros((0, len(model.langs)))
    n = np.array([len(said[i]) for i in told], np.int64)
    col = {c: out[c].to_numpy(copy=True) for c in out}
    col["own"][told], col["total"][told] = own, np.where(n < 4, 0, n)
    col["other"][told] = (heard.max(1, initial=0.0) > 0.98) & (heard[np.arange(len(told)), own] < 0.01)
    judged, own, n = told[n >= 4], own[n >= 4], n[n >= 4]
    word, at = np.array([_word(w) for i in judged for w in said[i]], np.int64), np.repeat(np.arange(len(judged)), n)
    new = ~model.seen[own[at], word]
    lacks = defaultdict(Counter)
    for i, w in zip(judged[at[new]].tolist(), word[new].tolist()):
        lacks[i][w] += 1
    for i, c in lacks.items():
        col["fresh"][i], col["often"][i] = [*c], [*c.values()]
    return pd.DataFrame(col)


def _form(q: str | None, a: str | None) -> tuple[str | None, int]:
    """What the pair alone tells, and the response's number of words: a defect; ``end`` where the ends of other responses
    decide; ``begin`` where their beginnings do."""
    said = plain(a)
    if not _FIVE(content := _without_lead(said)):
        content = _ODD.sub("", content)
        if not content or content.casefold() in ("null", "none", "nan") or said.strip().casefold() == "n/a":
            return "empty", 0
    if q and _is_copy(q, a):
        return "copy", 0
    even = said.replace("’", "'").strip()
    low = even.lower()
    if (any(x in low for x in DECLINES) or not _EVEN(even)) and REFUSAL.search(even):
        return "refusal", 0
    tail = _MARKS.sub("", even) if even.endswith(("...", "…")) else even
    marked = tail != even
    if OPEN_ENDS.search(tail.rstrip()[-12:]):  # longer than any of these ends
        return "truncated", 0
    n = len(tail.split())
    last = tail.rstrip(CLOSERS)
    if marked or not last.endswith(STOPS):
        if tail.count("(") > tail.count(")"):
            return "truncated", n
        korean = bool(_HANGUL(last.split()[-1] if last.split() else ""))
        if korean and CLOSED_KO.search(last) and len(last.split()[-1]) >= 3:
            return None, n
        if marked or n >= (3 if korean else 4):  # a sentence, not a bare value
            return "end", n
        if not korean:
            return "begin", n
    return None, n


_SMALL = {"the", "was", "were", "are", "answer", "you", "asked", "question", "thanks", "please", "답변", "질문"}
_ASKING = {"what", "who", "which", "how", "where", "when", "in", "at", "by", "on", "quick", "question"}


def _skeleton(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[A-Z][\p{L}\p{M}'-]*(?: [A-Z][\p{L}\p{M}'-]*)*", "N")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[0-9]+([.,:-][0-9]+)*", "0"), r"[.!?。]+['\"”’)\]]*\s*$", ""))


def _ends(words: Column) -> Column:
    """Words as they count for ends: of a Korean word the last two syllables."""
    return F.transform(words, lambda w: F.regexp_replace(w, r"^.*(?=[가-힣0]{2}$)", ""))


def _pair_id() -> Column:
    return F.unhex(F.sha2(F.concat_ws("\0", F.coalesce(F.concat(F.lit("q"), "prompt"), F.lit("")), F.coalesce(F.concat(F.lit("a"), "response"), F.lit(""))), 256))


def _run(words: Column, last: Column, k: int) -> Column:
    """The ``k`` words up to place ``last`` (from 1), null if there are fewer."""
    return F.when(last >= k, F.concat_ws(" ", *[F.get(words, last - F.lit(i)) for i in range(k, 0, -1)]))


def end_likelihood(said: DataFrame, asked: DataFrame, *, strength: float = 2.0, usual: float = 0.1) -> DataFrame:
    """``said`` (stopped, e): all responses; per run of one to three words it is counted how often they end with it and go on
    after it. Per rid of ``asked`` (rid, e) the likelihood ``p_end`` that a text ends after its last words, smoothed from three words
    to two to one."""
    at, n = F.col("at"), F.size("e")
    each = said.where(n > 0).select("stopped", "e", F.explode(F.sequence(F.lit(1), n)).alias("at"))
    each = each.select(((at == n) & F.col("stopped")).cast("int").alias("end"), (at < n).cast("int").alias("on"), F.stack(F.lit(3), *[x for k in (1, 2, 3) for x in (F.lit(k), _run(F.col("e"), at, k))]).alias("k", "g"))
    counts = each.where("g is not null").groupBy("k", "g").agg(F.sum("end").alias("ends"), F.sum("on").alias("goes"))
    tails = asked.where(n > 0).select("rid", F.stack(F.lit(3), *[x for k in (1, 2, 3) for x in (F.lit(k), _run(F.col("e"), n, k))]).alias("k", "g")).where("g is not null")
    told = tails.join(counts, ["k", "g"], "left").groupBy("rid").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("ends", "goes")])
    p = F.lit(usual)
    for k in (1, 2, 3):
        ends, goes = F.coalesce(f"ends{k}", F.lit(0)), F.coalesce(f"goes{k}", F.lit(0))
        p = (ends + strength * p) / (ends + goes + strength)
    return told.select("rid", p.alias("p_end"))


def defects(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``pairs``: prompt, response and any other columns; adds ``defect`` (null where there is none), in place of a column of that name."""
    pairs = pairs.drop("defect")
    texts = cut(pairs.select("prompt", "response").distinct().withColumn("pid", _pair_id()), "pairs")
    model = LanguageModel(labelled)
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    # All pairs are read once in Python: what a pair tells by itself, and its words that labelled texts lack.
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = list(zip(b.prompt, b.response))
            told = pd.DataFrame([_form(*x) for x in of], columns=["form", "n"])
            yield pd.concat([b[["pid", "rid"]], told, _languages(of, shared.value)], axis=1)

    rid = F.unhex(F.sha2("response", 256)).alias("rid")
    read = texts.select("pid", rid, "prompt", "response").mapInPandas(run, "pid binary, rid binary, form string, n int, own int, other boolean, total int, fresh array<int>, often array<int>")
    read = cut(read, "read")
    model.learn_new(read)
    learned = pairs.sparkSession.sparkContext.broadcast(model)

    def languages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new, own = np.zeros(len(b)), b.own.to_numpy(np.int64)
            at = np.repeat(np.arange(len(b)), [len(x) for x in b.fresh])
            if len(at):
                left = ~learned.value.seen[own[at], np.concatenate([*b.fresh])]
                new = np.bincount(at, left * np.concatenate([*b.often]), len(b))
            other, judged = b.other.to_numpy(bool), b.total.to_numpy() > 0
            other[judged] |= learned.value.unseen(new[judged], b.total.to_numpy()[judged], own[judged]) > 0.98
            yield b[["pid", "rid", "form", "n"]].assign(other=other)

    judged = read.mapInPandas(languages, "pid binary, rid binary, form string, n int, other boolean")

    # Ends of all distinct responses: whole wordings that end with a stop, last words at an end or inside, and how responses begin.
    said = texts.where(F.col("response").isNotNull()).groupBy("response").agg(F.count("*").alias("times"))
    said = said.select("times", rid, (F.col("response").rlike(r"[.!?。]['\"”’)\]]*\s*$") & ~F.col("response").rlike(r"(\.\.\.|…)\s*$")).alias("stopped"), _skeleton(F.col("response")).alias("sk"))
    said = cut(said.withColumn("e", _ends(F.filter(F.split("sk", " "), lambda w: w != ""))), "said")
    words, n = F.col("words"), F.size("words")
    begin = [x for k in (1, 2, 3) for x in (F.when(n >= k, _run(words, F.lit(k), k)), (n > k).cast("int"), F.lit(0))]
    forms = said.select("sk", "stopped", F.split("sk", " ").alias("words")).select(F.stack(F.lit(4), *begin, F.col("sk"), F.lit(None).cast("int"), F.col("stopped").cast("int")).alias("sk", "on", "whole"))
    forms = forms.where("sk is not null").groupBy("sk").agg(F.sum("on").alias("begins"), F.sum(1 - F.col("on")).alias("alone"), F.sum("whole").alias("wording"))
    # Only of responses that the ends or beginnings of others decide is it asked.
    asked = cut(said.join(read.where("form in ('end', 'begin')").select("rid").distinct(), "rid", "left_semi"), "asked")
    worded = F.size(F.array_except(F.split("sk", r"[\s\p{Z}\x1c-\x1f\x85]+"), F.array(F.lit("N"), F.lit("0"), F.lit("")))) > 0
    known = asked.join(forms, "sk", "left").join(end_likelihood(said, asked), "rid", "left")
    known = known.select("rid", "times", worded.alias("worded"), F.coalesce("wording", F.lit(0)).alias("wording"), (F.coalesce("begins", F.lit(0)) > F.coalesce("alone", F.lit(0))).alias("begun"), F.coalesce("p_end", F.lit(0.0)).alias("p_end"))

    broken = F.expr("form = 'end' and wording = 0 and p_end < 0.5 and not (n <= 4 and times >= 4) or form = 'begin' and begun and worded")
    defect = F.when(F.col("form").isin("empty", "copy", "refusal", "truncated"), F.col("form")).when(broken, "truncated").when(F.col("other"), "other_language")
    found = judged.where("form is not null or other").join(known, "rid", "left").select(F.col("pid").alias("_tw_found"), defect.alias("defect")).where("defect is not null")
    return pairs.withColumn("_tw_pair", _pair_id()).join(found, F.col("_tw_pair") == F.col("_tw_found"), "left").drop("_tw_pair", "_tw_found")
