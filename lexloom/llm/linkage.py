"""Matching entities across two tables without a common key: probabilistic record linkage.

1. Keys. Every row gets the skeletons of its word and of all its spellings: look-alike characters, accents, case,
   homograph numbers and orthographic variants (v/u, k/c, y/i, j/i) no longer show. Glosses become sets of telling
   words: words in more than `stop_share` of all glosses are dropped, each lemma counted alike.
2. Multi-pass blocking. Rows meet if they share any skeleton, or if their words are at most two edits apart (for words
   misspelled or inflected throughout), whatever their glosses. Distinct words that near are found by keys that miss
   none: of three parts of a word, two edits leave one whole. A pair is compared once, however many blocks it shares.
   Blocks with more than
   `hot_pairs` pairs are cut into a grid of parts, by a hash of the rows on either side; every pair of the block falls
   into one part, so the size of a block has no influence on what is compared.
3. Learning from the candidates themselves: which words stand for each other (the one word by which glosses of else
   equal content differ) and which dictionary number of one table is which of the other.
4. Comparison in agreement levels: word, gloss, label, dictionaries, and whether either row has a partner with a
   better gloss (lemmas spelled alike mostly have).
5. Expectation-maximisation of match and non-match probabilities (Fellegi-Sunter) over the counts of the comparison
   patterns; there are at most a few hundred patterns whatever the input, and only their counts are fetched. The
   posterior of a pattern is the confidence of its pairs.

Defined cases: null or empty words and spellings give no skeleton; rows without any key are linked to nothing; a null
label or gloss is a level of its own and speaks neither for nor against; rows given twice are linked each; a row can
have no partner or several; empty tables give no pairs. Columns besides row_id, word, members, label, gloss are
ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata as U
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.casefold import casefold
from lexloom.llm import lookalikes
from lexloom.session import bounded, cut_lineage, discard

LETTERS = re.compile(r"[^\W\d_]+")
HOMOGRAPH = re.compile(r" \(\d+\)$")
NO_KEY = re.compile(r"[^a-z0-9 ]")
#: Grammar labels and connectives of dictionaries, no part of a meaning.
GRAMMAR = frozenset("adj adv prep conj pron especially".split())
#: Letters written for each other in one language's spelling.
VARIANTS = str.maketrans("vkyj", "ucii")
#: Edits by which words misspelled throughout may differ.
EDITS = 2
#: The share of lemmas in whose glosses a word tells nothing.
STOP_SHARE = 0.08
LEVELS = ("word_level", "gloss_level", "label_level", "dict_level", "rival_level")
#: The gloss level from which another pair of the same row is a rival.
GOOD_GLOSS = 3


@functools.cache
def _sign(c: str) -> str:
    """What a character shows, the same for all look-alikes."""
    roots = _roots()
    return roots.get(c, c)


@functools.cache
def _roots() -> dict[str, str]:
    return {m: min(ms, key=lambda x: (len(x), x)) for ms in lookalikes.classes().values() for m in ms if len(m) == 1}


def skeletons(text: str | None) -> list[str]:
    """The spelling without anything that formatting, orthography or look-alikes change; none for null or empty.

    Capitals may look alike where small letters don't, and the other way round, so there can be a second one.
    """
    return list(_skeletons(text)) if text else []


@functools.lru_cache(1 << 16)
def _skeletons(text: str) -> tuple[str, ...]:
    if text.isascii() and text.isprintable():
        # every ASCII character stands for itself
        key = " ".join(NO_KEY.sub("", HOMOGRAPH.sub("", text.strip()).lower()).translate(VARIANTS).split())
        return (key,) if key else ()
    text = "".join(" " if lookalikes.other_space(c) else c for c in text if not lookalikes.unseen(c))
    text = U.normalize("NFKC", HOMOGRAPH.sub("", text.strip()))
    out = []
    for folded in (text.casefold(), "".join(map(_sign, text)).casefold()):
        plain = "".join(_sign(c) for c in U.normalize("NFKD", folded) if c.isalnum() or c == " ")
        key = " ".join(plain.casefold().translate(VARIANTS).split())
        if key and key not in out:
            out.append(key)
    return tuple(out)


def label_key(label: str | None) -> str | None:
    """The name a label begins with, without article, case and signs; labels are shortened at their end."""
    if not label:
        return None
    words = [w for w in LETTERS.findall(label.casefold()) if w != "the"]
    return "".join(words)[:8] or None


def words_of(gloss: str | None) -> list[str]:
    return [] if not gloss else [w for w in LETTERS.findall(U.normalize("NFKC", gloss).casefold()) if len(w) > 2 and w not in GRAMMAR]


def _common(rows: DataFrame, stop_share: float) -> set[str]:
    """Of described rows, see common_words."""
    rows = rows.filter("gloss is not null").select(F.coalesce("lemma", F.concat(F.lit("<"), "gloss")).alias("lemma"), "gloss").distinct()
    rows = cut_lineage(rows, "glosses")
    lemmas = rows.groupBy("lemma").agg(F.count("*").alias("glosses"))
    n = lemmas.count()
    # each gloss of a lemma has its part of the lemma's weight, so words are added up before their shuffle
    words = F.array_distinct(F.regexp_extract_all(F.lower("gloss"), F.lit(r"\p{L}+"), F.lit(0)))
    shares = rows.join(lemmas, "lemma").select((1 / F.col("glosses")).alias("n"), F.explode(words).alias("w")).groupBy("w").agg(F.sum("n").alias("n"))
    out = {r.w for r in shares.filter(F.round("n", 6) > stop_share * n).collect()}
    discard(rows)
    return out


def common_words(*tables: DataFrame, stop_share: float = STOP_SHARE) -> set[str]:
    """Words in more than stop_share of all glosses if every lemma has the same weight, however many rows it has.

    There are at most (words of a gloss) / stop_share of them. Rows without any spelling are lemmas of their own.
    """
    return _common(functools.reduce(DataFrame.unionByName, [described(t, None) for t in tables]), stop_share)


def _cuts(length: int) -> list[int]:
    return [length * i // (EDITS + 1) for i in range(EDITS + 2)]


def own_parts(word: str) -> set[str]:
    """EDITS + 1 parts of the word, with its length: EDITS edits leave at least one of them whole."""
    at = _cuts(len(word))
    return {f"<{len(word)}.{i}.{word[at[i] : at[i + 1]]}" for i in range(EDITS + 1)}


def parts_met(word: str) -> set[str]:
    """The own_parts of other words that this one holds where they can stand if it is at most EDITS edits away.

    Part i is looked for where at most i edits lie before it and at most EDITS - i behind it; some part is always there
    (Li, Deng, Wang and Feng 2011).
    """
    out = set()
    for length in range(max(1, len(word) - EDITS), len(word) + EDITS + 1):
        at, more = _cuts(length), len(word) - length
        for i in range(EDITS + 1):
            size = at[i + 1] - at[i]
            first, last = max(at[i] - i, at[i] + more - (EDITS - i), 0), min(at[i] + i, at[i] + more + EDITS - i, len(word) - size)
            out |= {f"<{length}.{i}.{word[p : p + size]}" for p in range(first, last + 1)}
    return out


#: Texts of other signs than printable ASCII have their keys derived in Python, all others in the JVM.
SPECIAL = r"[^\x20-\x7e]"


def _plain_skeleton(text: Column) -> Column:
    """skeletons of a text of printable ASCII: one key, or an empty one."""
    bare = F.regexp_replace(F.trim(text), r" \(\d+\)\z", "")
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(F.lower(bare), "[^a-z0-9 ]", ""), "vkyj", "ucii"), " +", " "))


def _label_key(label: Column) -> Column:
    """label_key as an expression."""
    words = F.filter(F.regexp_extract_all(casefold(label), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w != "the")
    key = F.left(F.array_join(words, ""), F.lit(8))
    return F.when(key != "", key)


def described(rows: DataFrame, dict_labels: dict[int, str] | None) -> DataFrame:
    """Rows with their skeletons, gloss words, labels and dictionaries; dict_labels gives the labels of a row's dictionaries where its numbers are known."""

    @F.pandas_udf("array<array<string>>")
    def keys_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda ts: None if ts is None else [list(_skeletons(t)) for t in ts])

    @F.pandas_udf("array<string>")
    def telling(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for glosses in batches:
            yield glosses.map(lambda g: None if g is None else sorted(set(words_of(g))))

    spelled = F.array_distinct(F.filter(F.concat(F.array("word"), F.coalesce(F.transform("members", lambda m: m["spelling"]), F.array().cast("array<string>"))), lambda t: t.isNotNull() & (t != "")))
    df = rows.select("row_id", "word", "members", "label", "gloss").withColumn("_t", spelled)
    df = df.withColumn("_s", F.filter("_t", lambda t: t.rlike(SPECIAL)))
    df = df.withColumn("_k", keys_of(F.when(F.size("_s") > 0, F.col("_s"))))
    df = df.withColumn("_g", telling(F.when(F.col("gloss").rlike(SPECIAL), F.col("gloss"))))
    # keys of each text, in the order of the texts
    each = F.transform("_t", lambda t: F.when(t.rlike(SPECIAL), F.get("_k", F.array_position("_s", t).cast("int") - 1)).otherwise(F.filter(F.array(_plain_skeleton(t)), lambda k: k != "")))
    df = df.withColumn("_e", F.coalesce(each, F.array().cast("array<array<string>>")))
    own = F.when(F.col("word").isNotNull() & (F.col("word") != ""), F.get(F.get("_e", F.lit(0)), F.lit(0)))
    plain = F.filter(F.regexp_extract_all(F.lower("gloss"), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(GRAMMAR)))
    dicts = F.array_sort(F.array_distinct(F.filter(F.transform("members", lambda m: m["dict"]), lambda x: x.isNotNull())))
    label = _label_key(F.col("label"))
    known = F.array(label)
    if dict_labels:
        names = F.create_map(*[F.lit(x) for d, t in dict_labels.items() for x in (d, label_key(t))])
        known = F.concat(known, F.coalesce(F.transform("_d", lambda x: F.try_element_at(names, x)), F.array().cast("array<string>")))
    df = df.withColumns({"_w": own, "_d": F.coalesce(dicts, F.array().cast("array<int>"))})
    return df.select(
        "row_id", F.array_sort(F.array_distinct(F.flatten("_e"))).alias("exact"), F.coalesce("_w", F.lit("")).alias("word_key"),
        F.coalesce("_g", F.array_sort(F.array_distinct(plain)), F.array().cast("array<string>")).alias("tokens"), label.alias("label"),
        F.array_sort(F.array_distinct(F.filter(known, lambda k: k.isNotNull()))).alias("labels"), F.col("_d").alias("dicts"),
        F.coalesce("_w", F.get(F.flatten("_e"), F.lit(0))).alias("lemma"), "gloss",
    ).withColumn("rid", F.monotonically_increasing_id())


def without_common(rows: DataFrame, stop: set[str]) -> DataFrame:
    """Described rows with their telling gloss words only."""
    return rows.withColumn("tokens", F.array_except("tokens", F.array(*map(F.lit, sorted(stop))).cast("array<string>"))).drop("lemma", "gloss")


def near_keys(word: Column, side: str | None) -> Column:
    """Keys by which words at most EDITS apart meet: one has the parts of side h and the other those of side g; without a side, a word has both."""

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return words.map(lambda w: sorted((own_parts(w) if side != "g" else set()) | (parts_met(w) if side != "h" else set())) if w else [])

    return keys(word)


def prepared(rows: DataFrame, stop: set[str], dict_labels: dict[int, str] | None, side: str | None = None) -> DataFrame:
    """Rows described, without common words, and with all their keys, to look at; candidates derives the keys of distinct words itself."""
    own = without_common(described(rows, dict_labels), stop)
    return own.withColumn("keys", F.array_sort(F.array_union("exact", near_keys(F.col("word_key"), side))))


def meeting(home: DataFrame, guest: DataFrame, hot_pairs: int) -> DataFrame:
    """All pairs of home (key, h_id) and guest (key, g_id) that share a key, once per key; blocks over hot_pairs are cut into a grid."""
    # written once, as keys are counted and joined
    home, guest = (cut_lineage(df, "meeting") for df in (home, guest))
    one = lambda df, h, g: df.select("key", F.lit(h).alias("h"), F.lit(g).alias("g"))
    sizes = one(home, 1, 0).unionByName(one(guest, 0, 1)).groupBy("key").agg(F.sum("h").alias("nh"), F.sum("g").alias("ng"))
    side_parts = F.ceil(F.sqrt(F.col("nh") * F.col("ng") / F.lit(max(hot_pairs, 1)))).cast("int")
    hot = cut_lineage(sizes.filter(F.col("nh") * F.col("ng") > hot_pairs).select("key", side_parts.alias("parts")), "hot")
    if hot.isEmpty():
        return home.join(guest, "key")
    hot = bounded(hot)

    def parted(df: DataFrame, p: str) -> DataFrame:
        own = F.pmod(F.xxhash64(f"{p}_id"), F.col("parts")).cast("int")
        # a row is in one line of the grid: home rows in a line across, guest rows in a line down
        line = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: own * F.col("parts") + x if p == "h" else x * F.col("parts") + own)
        return df.join(hot, "key", "left").select("key", f"{p}_id", F.explode(F.when(F.col("parts").isNotNull(), line).otherwise(F.array(F.lit(0)))).alias("part"))

    return parted(home, "h").join(parted(guest, "g"), ["key", "part"])


def candidates(home: DataFrame, guest: DataFrame, hot_pairs: int = 1_000_000) -> DataFrame:
    """All pairs that share a skeleton or whose words are at most EDITS apart, each once, with the prepared columns of both rows (h_..., g_...).

    Words near each other are found among distinct words, so that the number of their rows has no part in it; rows go
    through the blocks as numbers only, and the other columns are joined to the pairs that are left.
    home and guest are read more than once and must give the same rids each time, as written tables do.
    """

    def words(df: DataFrame, p: str) -> DataFrame:
        each = df.filter("word_key <> ''").select("word_key").distinct()
        return each.select(F.col("word_key").alias(f"{p}_id"), F.explode(near_keys(F.col("word_key"), p)).alias("key"))

    near = meeting(words(home, "h"), words(guest, "g"), hot_pairs).filter((F.col("h_id") != F.col("g_id")) & (F.levenshtein("h_id", "g_id", EDITS) >= 0))
    near = cut_lineage(near.select(F.col("h_id").alias("h_word"), F.col("g_id").alias("g_word")).distinct(), "near")

    def keyed(df: DataFrame, p: str) -> DataFrame:
        same = df.select(F.explode("exact").alias("key"), F.col("rid").alias(f"{p}_id"))
        pair = near.select(F.col(f"{p}_word").alias("word_key"), F.concat(F.lit("<"), "h_word", F.lit("<"), "g_word").alias("key"))
        return same.unionByName(df.select("rid", "word_key").join(pair, "word_key").select("key", F.col("rid").alias(f"{p}_id")))

    pairs = meeting(keyed(home, "h"), keyed(guest, "g"), hot_pairs).select(F.col("h_id").alias("h_rid"), F.col("g_id").alias("g_rid")).distinct()
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("keys", "lemma", "gloss")])
    return pairs.join(side(home, "h"), "h_rid").join(side(guest, "g"), "g_rid")


def synonym_table(pairs: DataFrame, least: int = 5, share: float = 0.4) -> DataFrame:
    """g (guest word), h (home word): from pairs whose glosses agree in two or more words and differ in just one.

    Evidence is what differs in word or glosses, `least` such cases whatever the size of the tables; which word stands
    for g is told by the number of lemmas, so that one with many rows has one voice.
    """
    only = lambda a, b: F.array_except(f"{a}_tokens", f"{b}_tokens")
    one = (
        pairs.filter((F.size(F.array_intersect("h_tokens", "g_tokens")) > 1) & (F.size(only("g", "h")) == 1) & (F.size(only("h", "g")) == 1))
        .select(F.get(only("g", "h"), F.lit(0)).alias("g"), F.get(only("h", "g"), F.lit(0)).alias("h"), "h_word_key", "h_tokens", "g_tokens")
        .distinct()
        .groupBy("g", "h", "h_word_key")
        .agg(F.count("*").alias("n"))
        .groupBy("g", "h")
        .agg(F.count("*").alias("lemmas"), F.sum("n").alias("n"))
    )
    by = one.groupBy("g").agg(F.sum("lemmas").alias("all"), F.max(F.struct("lemmas", "n", "h")).alias("best"))
    return by.filter((F.col("best.n") >= least) & (F.col("best.lemmas") >= share * F.col("all"))).select("g", F.col("best.h").alias("h"))


def learned_synonyms(pairs: DataFrame, least: int = 5, share: float = 0.4) -> dict[str, str]:
    """synonym_table as a dict, to look at; link joins the table instead."""
    return {r.g: r.h for r in synonym_table(pairs, least, share).collect()}


def translated(guest: DataFrame, synonyms: DataFrame) -> DataFrame:
    """g_rid, g_same: the gloss words of the guest rows that have any, with each word in place of its synonym."""
    words = guest.select(F.col("rid").alias("g_rid"), F.explode("tokens").alias("g"))
    return words.join(synonyms, "g", "left").groupBy("g_rid").agg(F.collect_set(F.coalesce("h", "g")).alias("g_same"))


def learned_dicts(pairs: DataFrame, least: int = 20) -> dict[int, int]:
    """guest dict -> home dict that most often holds the same lemma, beyond what its size explains.

    Fetched are counts by pair of dictionary numbers, of which a collection has few.
    """
    sure = pairs.filter((F.size(F.array_intersect("h_tokens", "g_tokens")) > 2) & (F.size("g_dicts") > 0))
    both = sure.select("h_dicts", F.explode("g_dicts").alias("g")).select("g", F.explode("h_dicts").alias("h")).groupBy("g", "h").agg(F.count("*").alias("n"))
    counts = both.filter(F.col("n") >= least).toPandas()
    if counts.empty:
        return {}
    counts["lift"] = counts.n / np.sqrt(counts.groupby("g").n.transform("sum") * counts.groupby("h").n.transform("sum"))
    return {int(r.g): int(r.h) for r in counts.sort_values("lift").groupby("g").tail(1).itertuples()}


def compared(pairs: DataFrame, spoken: DataFrame, dicts: dict[int, int]) -> DataFrame:
    """Pairs with their agreement levels; -1 where an attribute is missing on either side. spoken: guest words as translated gives them."""
    table = lambda m, kind: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast(kind)
    same = F.coalesce("g_same", F.array().cast("array<string>"))
    df = pairs.join(spoken, "g_rid", "left").withColumn("same", F.array_intersect(same, "h_tokens")).withColumn("g_size", F.size(same))
    shorter = F.least("g_size", F.size("h_tokens"))
    ratio = F.size("same") / shorter
    gloss = (
        F.when((shorter == 0), -1).when(F.size("same") == 0, 0).when((F.size("same") == 1) & (shorter > 1), 1).when(ratio < 0.6, 2).when(ratio < 0.99, 3).otherwise(4)
    )
    label = F.when(F.col("g_label").isNull() | (F.size("h_labels") == 0), -1).when(F.array_contains("h_labels", F.col("g_label")), 1).otherwise(0)
    mapped = F.array_distinct(F.filter(F.transform("g_dicts", lambda x: F.try_element_at(table(dicts, "map<int,int>"), x)), lambda x: x.isNotNull()))
    held = F.size(F.array_intersect(mapped, "h_dicts"))
    part = held / F.greatest(F.least(F.size(mapped), F.size("h_dicts")), F.lit(1))
    shelf = F.when((F.size(mapped) == 0) | (F.size("h_dicts") == 0), -1).when(held == 0, 0).when(part < 0.75, 1).when(held == 1, 2).otherwise(3)
    word = F.when(F.col("h_word_key") == F.col("g_word_key"), 2).when(F.arrays_overlap("h_exact", "g_exact"), 1).otherwise(0)
    # written once, as narrow rows, since rivals are counted among all of them
    levels = df.select(
        "h_rid", "g_rid", F.col("h_row_id").alias("row_a"), F.col("g_row_id").alias("row_b"),
        word.alias("word_level"), gloss.alias("gloss_level"), label.alias("label_level"), shelf.alias("dict_level"),
    )
    levels = cut_lineage(levels, "levels")
    # does either row have a better partner by its gloss?
    good = (F.col("gloss_level") >= GOOD_GLOSS).cast("int")
    better = levels.filter(good == 1)
    for rid in ("h_rid", "g_rid"):
        levels = levels.join(better.groupBy(rid).agg(F.count("*").alias(f"{rid}_good")), rid, "left")
    rival = (F.greatest(F.coalesce("h_rid_good", F.lit(0)), F.coalesce("g_rid_good", F.lit(0))) - good > 0).cast("int")
    return levels.select("row_a", "row_b", "word_level", "gloss_level", "label_level", "dict_level", rival.alias("rival_level"))


#: What is taken as independent given match or not. A label names one of the row's dictionaries, so these two go together.
ATTRIBUTES = (("word_level",), ("gloss_level",), ("label_level", "dict_level"), ("rival_level",))


def expectation_maximisation(patterns: pd.DataFrame, rounds: int = 300) -> pd.DataFrame:
    """patterns: one row per combination of levels with its count n; gives each the posterior of a match.

    Missing attributes (level -1 throughout) don't count. The start is a guess that the better the gloss and the
    dictionaries agree, the likelier the match; which levels tell how much is learned.
    """
    n = patterns.n.to_numpy(float)
    codes = []
    for columns in ATTRIBUTES:
        values = patterns[list(columns)]
        code = pd.Series(values.itertuples(index=False, name=None)).map(str)
        codes.append((pd.factorize(code, sort=True)[0], (values >= 0).any(axis=1).to_numpy()))
    guess = [np.where(v < 0, 0.5, v / max(v.max(), 1)) for v in (patterns.gloss_level.to_numpy(), patterns.gloss_level.to_numpy(), patterns.dict_level.to_numpy())]
    post = np.clip(np.mean(guess, axis=0), 0.02, 0.98)
    for _ in range(rounds):
        prior = (n @ post + 1) / (n.sum() + 2)
        log = np.full(len(n), np.log(prior) - np.log1p(-prior))
        for code, there in codes:
            size = len(set(code[there])) or 1
            for level in set(code[there]):
                at = code == level
                m = (n[at] @ post[at] + 0.5) / (n[there] @ post[there] + 0.5 * size)
                u = (n[at] @ (1 - post[at]) + 0.5) / (n[there] @ (1 - post[there]) + 0.5 * size)
                log[at] += np.log(m) - np.log(u)
        new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return patterns.assign(confidence=post)


def link(home: DataFrame, guest: DataFrame, dictionaries: DataFrame | None = None, least: float = 0.5, hot_pairs: int = 1_000_000) -> DataFrame:
    """row_a, row_b, the levels and confidence of all pairs with a confidence of at least `least`."""
    labels = {} if dictionaries is None else {r.dict: r.label for r in dictionaries.select("dict", "label").collect()}
    # written once: blocks are counted and joined from them
    both = [cut_lineage(described(t, known), "rows") for t, known in ((home, labels), (guest, None))]
    stop = _common(both[0].unionByName(both[1]), STOP_SHARE)
    ready = [without_common(t, stop) for t in both]
    pairs = cut_lineage(candidates(*ready, hot_pairs), "pairs")
    synonyms = bounded(cut_lineage(synonym_table(pairs), "synonyms"))
    spoken = cut_lineage(translated(ready[1], synonyms), "spoken")
    scored = cut_lineage(compared(pairs, spoken, learned_dicts(pairs)), "compared")
    discard(*both, pairs, spoken)
    patterns = scored.groupBy(*LEVELS).agg(F.count("*").alias("n")).toPandas()
    if patterns.empty:
        return scored.withColumn("confidence", F.lit(None).cast("double"))
    model = scored.sparkSession.createDataFrame(expectation_maximisation(patterns).drop(columns="n"))
    return scored.join(F.broadcast(model), list(LEVELS)).filter(F.col("confidence") >= least).select("row_a", "row_b", *LEVELS, "confidence")
