"""Same or near-same records across splits by an exact prefix-filter join on rare shingles.

A question is reduced to content words: typing, encoding, courtesies, small words, particles and endings made even,
slips mended towards words that are common in the corpus (where two words are as near, what was typed is kept
beside the choice). Its shingles are the unordered pairs of these words, so word order does not matter. Distinct
word sets are joined, evaluation against training: shingles are ordered from rare to common, prefixes of evaluation
sets are indexed, training prefixes probe them under length and position filters. Two sets may differ in
``differing`` of their words (one at least), each a slip of its counterpart; the prefixes are as long as that asks
for, so that no such pair is lost however short the questions are. The words left over then decide. Of two words that
differ one is common and the other is not, so shingles with an uncommon word come first in the order, and shingles of
common words alone need to meet only where the uncommon words of both sides can all be such slips. Korean questions
also meet by their letters without spaces, since spaces are often left out.

The list of common words is bounded: a word must be in ``common`` of all questions, so there are at most
(mean words per question) / common of them. They are counted over all questions.

Defined results: null or wordless texts match nothing; repeated rows give one pair; a record in both or in no
known split takes part on the sides it has; empty tables give no pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.pairs import bare, plain
from tidewell.session import cut

# Courtesies and lead-ins, small words, months, endings.
COURTESY = re.compile(
    r"\b(quick question|i was wondering|can you tell me|could you tell me|please tell me|tell me|do you know|does anyone know|anyone know|just curious|good (morning|evening|day)|excuse me|thank you( so much)?|thanks( in advance)?|many thanks|thx|ty|cheers|please|pls|plz|asap|urgent|repost|need this today|in advance|hello|hi|hey|dear all|question|help)\b|^\W*(q\b\W+)+"
    r"|안녕하세요|감사합니다|고맙습니다|부탁드려요|부탁드립니다|부탁해요|알려 ?주세요|알려 ?주실래요|가르쳐 ?주세요|궁금합니다|궁금해요|질문입니다|질문|혹시|급해요|[ㅠㅜㅎㅋ]+", re.I)  # fmt: skip
SMALL = frozenset("a an the of in on at by for to from is was were are did do does had has have it its as and or be been there that this".split())
MONTHS = {m[:3]: m for m in "january february march april may june july august september october november december".split()} | {"sept": "september"}
KO_END = re.compile(r"(인가요|인가|입니까|인지요|인지|이에요|예요|이죠|나요|습니까|는지요|는지|을까요|죠|나)$")
# Korean particles, after a final consonant, after a vowel, after either.
CLOSED, OPEN, EITHER = ("은", "이", "을", "과", "으로"), ("는", "가", "를", "와", "로"), ("의", "에서", "에게", "에", "도", "까지", "부터")
HANGUL = re.compile(r"[가-힣]")


def ko_stem(word: str) -> str:
    """A Korean word without its ending or particle; two syllables at least stay."""
    word = KO_END.sub("", word) or word
    for p in sorted((*CLOSED, *OPEN, *EITHER), key=len, reverse=True):
        rest = word[: -len(p)]
        if word.endswith(p) and len(rest) >= 2 and HANGUL.match(rest[-1]):
            final = (ord(rest[-1]) - 0xAC00) % 28 > 0
            if p in EITHER or (p in CLOSED) == final:
                return rest
    return word


def words_of(text: str | None) -> list[str]:
    """Content words in order, before slips are mended."""
    s = re.sub(r"[\u1100-\u11ff\u3130-\u318f]", "", COURTESY.sub(" ", bare(text)))  # bare letters of laughing and crying
    words = re.findall(r"[^\W_]+", re.sub(r"\bhow may\b", "how many", s))
    if HANGUL.search(s):
        return [stem for w in words for x in re.findall(r"\d+[년월일]|\d+|[^\W\d]+", w) if (stem := ko_stem(x)) not in EITHER]
    return [MONTHS.get(w, w) for w in words]


def letters_of(text: str | None) -> str:
    """A Korean question without spaces, dates first and the ending off; empty for others."""
    s = re.sub(r"[\u1100-\u11ff\u3130-\u318f]", "", COURTESY.sub(" ", bare(text)))
    if not HANGUL.search(s):
        return ""
    s = re.sub(r"[\W_]+", "", s)
    return "".join(re.findall(r"\d+년|\d+월|\d+일", s)) + "|" + KO_END.sub("", re.sub(r"(\d+년|\d+월|\d+일)에?", "", s))


def distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, or ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def slips(word: str) -> int:
    if HANGUL.search(word):  # letters of syllables count
        return 0 if len(word) < 2 or re.search(r"\d", word) else 1
    return 0 if len(word) < 3 or re.search(r"\d", word) else 1 if len(word) < 5 else 2


@lru_cache(maxsize=50_000)
def _parts(word: str) -> str:
    return unicodedata.normalize("NFD", word)


def _thinned(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Speller:
    """Mends words that are not common towards the nearest common one, found by what is left after leaving letters out."""

    def __init__(self, common: dict[str, int]):
        self.common, self.known, self.near = common, {}, {}
        for w in common:
            if slips(w):
                for x in _thinned(_parts(w), slips(w)):
                    self.near.setdefault(x, []).append(w)

    def mend(self, word: str) -> tuple[str, bool]:
        """The word or the common word that it is a slip of, and whether another common word is as near."""
        if word in self.common or word in SMALL or not slips(word):
            return word, False
        if word not in self.known:
            most, typed = slips(word), _parts(word)
            seen = {v for x in _thinned(typed, most) for v in self.near.get(x, ())}
            ranked = sorted((d, v in SMALL, -self.common[v], v) for v in seen if (d := distance(typed, _parts(v), min(most, slips(v)))) <= min(most, slips(v)))
            best = ranked[0] if ranked else (9, False, 0, word)
            self.known[word] = (best[3], len(ranked) > 1 and ranked[1][0] == best[0])
        return self.known[word]


def common_words(texts: DataFrame, common: float) -> dict[str, int]:
    """Words that stand in ``common`` of all texts, mostly not as names; at most mean words / common of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, lower, n = Counter(), Counter(), 0
            for t in b.text:
                n += 1
                tokens = re.findall(r"[^\W_]+", plain(COURTESY.sub(" ", plain(t))))
                flat = {ko_stem(bare(w)): w for w in reversed(tokens)}
                seen.update(flat.keys())
                lower.update(k for k, w in flat.items() if w[:1].islower() or HANGUL.match(w))
            yield pd.DataFrame([(w, c, lower[w]) for w, c in seen.items()] + [("", n, 0)], columns=["word", "n", "low"])

    counted = cut(texts.select("text").mapInPandas(count, "word string, n long, low long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low")), "words")
    whole = counted.where("word = ''").first()
    least = max(3.0, common * (whole["n"] if whole else 0))
    rows = counted.where((F.col("n") >= least) & (F.col("low") >= 0.3 * F.col("n")) & ~F.col("word").rlike(r"\d") & (F.length("word") > 1)).collect()
    held = {r.word: r.n for r in rows}
    # A slip may be common itself: it goes where a word 20 times as common is one edit away.
    slipped = {w for w, n in held.items() if slips(w) and any(m >= 20 * n and distance(_parts(w), _parts(v), 1) <= 1 for v, m in held.items())}
    return {MONTHS.get(w, w): n for w, n in held.items() if w not in slipped} | {w: 1 for w in ("what", "which", "who", "how", "where", "when")} | {w: 1 for w in MONTHS.values()}


def _same_words(a: list[str], b: list[str], typed_a: dict[str, str], typed_b: dict[str, str], common: set[str]) -> bool:
    """Whether the words that only one side has can be paired off as slips of each other.

    ``typed_*``: what was typed where a mended word could as well have been another.
    """
    x, y = Counter(a), Counter(b)
    left, right = sorted((x - y).elements()), sorted((y - x).elements())
    if len(left) != len(right):
        return False

    def slip(v: str, w: str, typed: dict[str, str]) -> bool:
        return v in typed and distance(_parts(typed[v]), _parts(w), slips(w)) <= slips(w)

    def fits(v: str, w: str) -> bool:
        if slip(v, w, typed_a) or slip(w, v, typed_b):
            return True
        most = min(slips(v), slips(w))
        return (v in common) != (w in common) and most > 0 and distance(_parts(v), _parts(w), most) <= most

    # Pair the words off by alternating paths.
    held: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j, w in enumerate(right):
            if j not in tried and fits(left[i], w):
                tried.add(j)
                if j not in held or place(held[j], tried):
                    held[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(left)))


def cross_split_pairs(records: DataFrame, *, differing: float = 0.2, common: float = 0.0008) -> DataFrame:
    """(rid_train, rid_eval). ``records``: rid, text, in_train, in_eval (booleans)."""
    rows = records.where("text is not null and rid is not null and (in_train or in_eval)").select("rid", "text", "in_train", "in_eval").distinct()
    vocabulary = records.sparkSession.sparkContext.broadcast(common_words(rows, common))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = Speller(vocabulary.value)
        for b in batches:
            sets, typed, rare = [], [], []
            for t in b.text:
                mended = [(*speller.mend(x), x) for x in words_of(t)]
                sets.append(sorted(w for w, _, _ in mended if w not in SMALL))
                typed.append(sorted(f"{w} {x}" for w, unsure, x in mended if unsure and w not in SMALL))
                unsure = {t.split(" ", 1)[0] for t in typed[-1]}
                rare.append(sorted({w for w in sets[-1] if slips(w) and (w not in vocabulary.value or w in unsure)}))
            yield b.drop(columns="text").assign(words=sets, typed=typed, rare=rare, letters=b.text.map(letters_of))

    reduced = rows.mapInPandas(reduce, "rid string, in_train boolean, in_eval boolean, words array<string>, typed array<string>, rare array<string>, letters string").where("size(words) > 0")
    reduced = cut(reduced.withColumn("kid", F.unhex(F.sha2(F.concat_ws("|", F.array_join("words", " "), F.array_join("typed", ",")), 256))), "reduced")
    sets = cut(reduced.groupBy("kid").agg(F.first("words").alias("words"), F.first("typed").alias("typed"), F.first("rare").alias("rare"), F.max("in_train").alias("t"), F.max("in_eval").alias("e")), "sets")

    # Shingles with whether no uncommon word is in them.
    shingles = F.expr("""array_distinct(concat(transform(words, x -> struct(not array_contains(rare, x) as weak, x as g)), flatten(transform(words, (x, i) ->
        transform(slice(words, i + 2, size(words)), y -> struct(not (array_contains(rare, x) or array_contains(rare, y)) as weak, concat(x, ' ', y) as g))))))""")
    size = F.size("words")
    apart = F.greatest(F.lit(1), F.floor(F.lit(differing) * size)).cast("int")
    shingled = sets.select("kid", "t", "e", size.alias("n"), apart.alias("d"), F.size(F.filter("words", lambda w: F.array_contains("rare", w))).alias("u"), shingles.alias("g"))
    # d words take away d single words and d (n - 1) pairs at most; so many shingles and one more make the prefix.
    grams = shingled.select("kid", "t", "e", "n", "d", "u", F.size("g").alias("m"), (F.col("d") * F.col("n") + 1).alias("first"), F.explode("g").alias("x")).select("*", "x.weak", "x.g").drop("x")
    rarity = grams.groupBy("g").agg(F.count("*").alias("df"))
    order = Window.partitionBy("kid").orderBy("weak", "df", "g")
    placed = cut(grams.join(rarity, "g").withColumn("pos", F.row_number().over(order) - 1).where("pos < first and (not weak or u <= d)"), "prefixes")
    # A weak shingle meets those of sets with so few uncommon words that all of both can be slips.
    own = F.when(F.col("weak"), F.col("u")).otherwise(-1)
    others = F.when(F.col("weak"), F.sequence(F.lit(0), F.greatest(F.col("d") - F.col("u"), F.lit(0)))).otherwise(F.array(F.lit(-1)))
    side = lambda keep, x, mine, partner: placed.where(keep).select("g", "n", own.alias(mine), F.explode(others).alias(partner), *[F.col(c).alias(f"{c}_{x}") for c in ("kid", "d", "m", "pos")])
    # Length: as many words on both sides. Position: what is left behind both places must reach the shingles that have to be shared.
    fewest = F.least("d_e", "d_t")
    fits = 1 + F.least(F.col("m_e") - F.col("pos_e") - 1, F.col("m_t") - F.col("pos_t") - 1) >= F.greatest("m_e", "m_t") - fewest * F.col("n")
    near = side("e", "e", "ue", "ut").join(side("t", "t", "ut", "ue"), ["g", "n", "ue", "ut"]).where(fits & (F.col("kid_e") != F.col("kid_t"))).select(F.col("kid_e").alias("ke"), F.col("kid_t").alias("kt"), fewest.alias("d")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = set(vocabulary.value)
        told = lambda x: dict(t.split(" ", 1) for t in x)
        for b in batches:
            yield b.loc[[_same_words(list(x), list(y), told(p), told(q), known) for x, y, p, q in zip(b.words_ke, b.words_kt, b.typed_ke, b.typed_kt)], ["ke", "kt"]]

    word = lambda k: sets.select(F.col("kid").alias(k), F.col("words").alias(f"words_{k}"), F.col("typed").alias(f"typed_{k}"))
    left_over = F.size(F.array_except("words_ke", "words_kt")) <= F.col("d")
    close = near.join(word("ke"), "ke").join(word("kt"), "kt").where(left_over).drop("d").mapInPandas(verify, "ke binary, kt binary")
    same = sets.where("t and e").select(F.col("kid").alias("ke"), F.col("kid").alias("kt"))
    spelled = reduced.where("letters <> ''")
    glued = spelled.where("in_eval").select("letters", F.col("kid").alias("ke")).distinct().join(spelled.where("in_train").select("letters", F.col("kid").alias("kt")).distinct(), "letters").select("ke", "kt")
    links = cut(close.unionByName(same).unionByName(glued).distinct(), "links")
    train = reduced.where("in_train").select(F.col("kid").alias("kt"), F.col("rid").alias("rid_train"))
    held = reduced.where("in_eval").select(F.col("kid").alias("ke"), F.col("rid").alias("rid_eval"))
    return links.join(held, "ke").join(train, "kt").where("rid_train <> rid_eval").select("rid_train", "rid_eval").distinct()
