"""Array functions for names with scores, tags and token lists; all on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_list(cell: Column, separator: str = ", ") -> Column:
    """A delimited cell as an array; a blank cell is one blank value, NULL counts as blank."""
    return F.split(F.coalesce(cell, F.lit("")), f"\\Q{separator}\\E", -1)


def scored_names(names: Column, probs: Column) -> Column:
    """Arrays of names and scores as array<struct<name, prob>>: the shorter array counts, one-letter names are blank,
    blank names have score 0, a repeated name stands at its first place with its last score."""
    name = lambda x: F.when(F.length(x) == 1, F.lit("")).otherwise(x)
    score = lambda p: F.coalesce(p.try_cast("double"), F.lit(0.0))
    pair = lambda a, p: F.struct(name(a).alias("name"), F.when(F.length(a) <= 1, F.lit(0.0)).otherwise(score(p)).alias("prob"))

    def zipped(both: Column) -> Column:
        n = F.least(F.size(both["a"]), F.size(both["p"]))
        return F.zip_with(F.slice(both["a"], 1, n), F.slice(both["p"], 1, n), pair)

    return last_wins(let(F.struct(names.alias("a"), probs.alias("p")), zipped))


def last_wins(pairs: Column) -> Column:
    """array<struct<name, prob>> with each name once, at its first place, with its last score."""
    def chosen(all_pairs: Column) -> Column:
        names = F.array_distinct(F.transform(all_pairs, lambda p: p["name"]))
        return F.transform(names, lambda n: F.element_at(F.filter(all_pairs, lambda p: p["name"] == n), -1))

    return let(pairs, chosen)


def best_scored(pairs: Column) -> Column:
    """The name of the largest score, the first of equals; NULL for an empty array."""
    ranked = F.array_sort(F.transform(pairs, lambda p, i: F.struct((-p["prob"]).alias("a"), i.alias("b"), p["name"].alias("name"))))
    return F.get(ranked, F.lit(0))["name"]


def select_names(common: Column, common_prob: Column, full: Column, full_prob: Column) -> Column:
    """struct of best_common, best_full and best_name with their scores from four list cells.

    All scores are looked up in full names followed by common ones, so a shared name has its
    common score, and of equal scores the full name wins.
    """
    lists = F.struct(scored_names(split_list(common), split_list(common_prob)).alias("c"), scored_names(split_list(full), split_list(full_prob)).alias("f"))

    def with_both(x: Column) -> Column:
        return let(F.struct(x["c"].alias("c"), x["f"].alias("f"), last_wins(F.concat(x["f"], x["c"])).alias("all")), chosen)

    def chosen(x: Column) -> Column:
        def with_score(name: Column, label: str) -> list[Column]:
            score = F.element_at(F.filter(x["all"], lambda p: p["name"] == name), 1)["prob"]
            return [name.alias(label), score.alias(f"{label}_prob")]

        kinds = (("best_common", "c"), ("best_full", "f"), ("best_name", "all"))
        return F.struct(*[c for label, part in kinds for c in with_score(best_scored(x[part]), label)])

    return let(lists, with_both)


def sentence_list(text: Column) -> Column:
    """Sentences: cut at white space after a full stop, question or exclamation mark."""
    return F.split(F.trim(text), "(?<=[.?!])\\s+")


def word_list(sentence: Column) -> Column:
    """Words between white space."""
    return F.split(F.trim(sentence), "\\s+")


def align_labels(labels: Column, word_ids: Column, ignored: int = -100) -> Column:
    """A label for each sub-token: none for a missing word, an inner label for a later part of a word that begins an entity."""
    def label(w: Column, i: Column) -> Column:
        own = F.get(labels, w)
        again = (i > 0) & F.get(word_ids, F.greatest(i - 1, F.lit(0))).eqNullSafe(w)
        return F.when(w.isNull(), F.lit(ignored)).when(again & (own % 2 == 1), own + 1).otherwise(own)

    return F.transform(word_ids, label)


def kept_tags(predicted: Column, true: Column, names: dict[int, str], ignored: int = -100) -> Column:
    """Predicted tags by name where the true label is not the ignored one."""
    lookup = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    pairs = F.filter(F.arrays_zip(predicted.alias("p"), true.alias("t")), lambda z: z["t"] != ignored)
    return F.transform(pairs, lambda z: lookup[z["p"]])


def bio_tags(words: Column, full: Column, common: Column) -> Column:
    """B-, I- and O tags of the places where the words of a full (FUL) or common (COM) name stand in a row.

    ``full`` and ``common`` are array<array<string>>; blank names are none. A full name that
    holds a common one is left out. Where names overlap the one that begins later counts,
    of those that begin together the full one.
    """
    there = lambda names: F.filter(names, lambda n: (F.size(n) > 0) & (F.get(n, F.lit(0)) != ""))

    def tagged(x: Column) -> Column:
        holds = lambda n: F.exists(x["c"], lambda c: F.array_join(n, " ").contains(F.array_join(c, " ")))
        return let(F.struct(F.filter(x["f"], lambda n: ~holds(n)).alias("f"), x["c"].alias("c")), placed)

    def placed(x: Column) -> Column:
        longest = F.greatest(F.array_max(F.transform(F.concat(x["f"], x["c"]), lambda n: F.size(n))), F.lit(1))

        def tag(i: Column) -> Column:
            def earlier(found: Column, k: Column) -> Column:
                at = (i - k).cast("int") + 1
                here = lambda names: F.exists(names, lambda n: (F.size(n) > k) & (F.slice(words, at, F.size(n)) == n))
                prefix = F.when(k == 0, "B-").otherwise("I-")
                return F.coalesce(found, F.when(here(x["f"]), F.concat(prefix, F.lit("FUL"))).when(here(x["c"]), F.concat(prefix, F.lit("COM"))))

            return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.least(i.cast("int"), longest - 1)), F.lit(None).cast("string"), earlier), F.lit("O"))

        return F.transform(words, lambda w, i: tag(i))

    return let(F.struct(there(full).alias("f"), there(common).alias("c")), tagged)


def word_spans(text: Column) -> Column:
    """array<struct<start, end>> of the words between white space; positions from 0, ends exclusive."""
    pieces = F.regexp_extract_all(text, F.lit("\\s+|\\S+"), F.lit(0))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        end = (state["pos"] + F.length(piece)).cast("int")
        span = F.struct(state["pos"].alias("start"), end.alias("end"))
        return F.struct(end.alias("pos"), F.when(piece.rlike("\\S"), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def softmax_label(logits: Column, names: list[str]) -> Column:
    """struct<label, prob> of the largest of an array of logits (the first of equals), with its share of the exponentials."""
    def chosen(x: Column) -> Column:
        most = F.array_max(x)
        total = F.aggregate(x, F.lit(0.0), lambda t, v: t + F.exp(v - most))
        return F.struct(F.get(F.array(*map(F.lit, names)), (F.array_position(x, most) - 1).cast("int")).alias("label"), (1 / total).alias("prob"))

    return let(logits, chosen)


def assemble_entities(text: Column, spans: Column, word_ids: Column, labels: Column, probs: Column) -> Column:
    """array<struct<mention, label, prob>> from the labels (B-x, I-x, O) and scores of the sub-tokens of a text's words.

    ``spans``: array<struct<start, end>> of the words; ``word_ids``, ``labels``, ``probs``:
    the word, label and score of each sub-token. A word with a B opens an entity, else one
    with an I goes on with the open one or opens one, any other closes it. An entity is the
    text of its words with the sign after each; its score is the mean over its sub-tokens.
    One-letter, over-long and address-like entities are dropped.
    """
    tokens = F.arrays_zip(word_ids.alias("w"), labels.alias("l"), probs.alias("p"))
    kind = "struct<mention:string,label:string,total:double,n:int>"

    def word(span: Column, i: Column) -> Column:
        own = F.filter(tokens, lambda t: t["w"] == i)
        touches = (i > 0) & (F.get(spans, F.greatest(i - 1, F.lit(0)))["end"] == span["start"])
        begin = span["start"] + F.when(touches, 1).otherwise(0)
        part = F.substring(text, begin + 1, F.greatest(span["end"] + 1 - begin, F.lit(0)))
        first = lambda letter: F.get(F.filter(own, lambda t: t["l"].startswith(letter)), F.lit(0))["l"]
        label = F.coalesce(first("B"), F.when(part != " ", first("I")))
        return F.struct(part.alias("mention"), label.alias("label"), F.aggregate(own, F.lit(0.0), lambda a, t: a + t["p"]).alias("total"), F.size(own).alias("n"))

    def step(state: Column, w: Column) -> Column:
        last = F.element_at(state["done"], -1)
        grown = F.struct(F.concat(last["mention"], w["mention"]).alias("mention"), last["label"].alias("label"), (last["total"] + w["total"]).alias("total"), (last["n"] + w["n"]).alias("n"))
        before = F.slice(state["done"], 1, F.greatest(F.size(state["done"]) - 1, F.lit(0)))
        goes_on = w["label"].startswith("I") & state["open"]
        done = F.when(w["label"].isNull(), state["done"]).when(goes_on, F.concat(before, F.array(grown))).otherwise(F.concat(state["done"], F.array(w)))
        return F.struct(done.alias("done"), w["label"].isNotNull().alias("open"))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(False).alias("open"))
    found = F.aggregate(F.transform(spans, word), start, step, lambda s: s["done"])
    stripped = F.transform(found, lambda e: F.struct(F.regexp_replace(e["mention"], "^\\s+|\\s+$", "").alias("mention"), e["label"].alias("label"), (e["total"] / e["n"]).alias("prob")))
    return F.filter(stripped, lambda e: (F.length(e["mention"]) != 1) & (F.length(e["mention"]) <= 100) & ~e["mention"].contains("http"))
