"""License scans: a positional index of the licence texts' words, met by each file's rarest ones.

Main path: DataFrame functions only, and no shuffle of texts or words.

1. Each text is cut into words once. Its licence words (those of any template) and their positions are written as a narrow
   table; how many files have each word gives its inverse document frequency (one row a licence word reaches the driver).
2. A file looks up those templates whose mandatory key phrases it has the words of. In each, the ``rare_words`` postings whose
   words are the rarest (of the highest IDF) that the file has give places of the template's start: the word's position in
   the file less that in the template. The places on which they agree are kept (intersection by relative position).
3. At each such place every word of the mandatory key phrases must stand where the template has it.

All steps after the words are hashed intersections of position lists: linear in a file's licence words, however often
they repeat. A template that is one phrase, all of it mandatory, is thereby found at exactly the places where its words stand
consecutively, whatever the frequencies are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from daygrain.llm.common import as_table, ascii_lower

#: Characters between words, after A-Z were lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_WORDS = 2
MIN_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """A licence statement in words, its label and the phrases of it that must stand in their places."""

    label: str
    text: str
    key_phrases: tuple[str, ...]
    base: bool = False

    def words(self) -> list[tuple[str, int, bool]]:
        """(word, position, whether it is part of a key phrase)."""
        own, keys = self.text.split(), set()
        for phrase in self.key_phrases:
            wanted = phrase.split()
            at = next((i for i in range(len(own)) if own[i:i + len(wanted)] == wanted), None)
            if at is None or not wanted:
                raise ValueError(f"{phrase!r} does not stand in {self.text!r}")
            keys |= set(range(at, at + len(wanted)))
        return [(w, i, i in keys) for i, w in enumerate(own)]


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, (text,), base=True)


# The contract's phrases and labels.
BASE = (_phrase("cc-by", "cc by"), _phrase("gpl", "general public license"), _phrase("reserved", "all rights reserved"))

# Statements that published licences ask for, in words.
STATEMENTS = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files", ("permission is hereby granted free of charge", "documentation files")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify", "with or without fee")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license version", ("gnu affero general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to this work",
             ("waived all copyright and related or neighboring rights",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
)
LIBRARY = BASE + STATEMENTS

_MATCHES = "array<struct<label: string, base: boolean, starts: array<int>, share: double>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAPS, -1), "")


def licence_words(docs: DataFrame, id_col: str, text_col: str, library: tuple[Template, ...]) -> DataFrame:
    """(id, n_words, hits): each file's licence words with their positions, by position."""
    vocabulary = sorted({w for t in library for w, *_ in t.words()})
    files = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    hit = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word"))))
    return files.select("id", F.size("words").cast("long").alias("n_words"), F.filter(hit, lambda h: h.isNotNull()).alias("hits"))


def _index(library: tuple[Template, ...], files_with: dict[str, int]) -> Column:
    """The templates as one literal, postings from the rarest word to the commonest (ties by word and position)."""
    def posting(word, pos):
        return F.struct(F.lit(word).alias("word"), F.lit(pos).alias("pos"))
    rows = []
    for t in library:
        words = sorted(t.words(), key=lambda x: (files_with.get(x[0], 0), x[0], x[1]))
        rows.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*[posting(w, p) for w, p, _ in words]).alias("postings"),
            F.array(*[posting(w, p) for w, p, key in words if key]).alias("keys")))
    return F.array(*rows)


def _starts(hits: Column, posting: Column) -> Column:
    """Where a template would start if its word were each of the file's."""
    return F.transform(F.filter(hits, lambda h: h["word"] == posting["word"]), lambda h: h["pos"] - posting["pos"])


def _agreed(hits: Column, postings: Column, first: Column) -> Column:
    """The starts of ``first`` on which all ``postings`` agree."""
    return F.aggregate(postings, first, lambda kept, p: F.array_intersect(kept, _starts(hits, p)))


def _match(hits: Column, own: Column, template: Column, rare_words: int) -> Column:
    rare = F.slice(F.filter(template["postings"], lambda p: F.array_contains(own, p["word"])), 1, rare_words)
    near = _agreed(hits, rare, _starts(hits, F.get(rare, F.lit(0))))
    starts = F.sort_array(_agreed(hits, template["keys"], near))
    # an outer transform binds the starts once
    return F.get(F.transform(F.array(starts), lambda s: F.struct(
        template["label"].alias("label"), template["base"].alias("base"), s.alias("starts"),
        F.try_divide(F.aggregate(template["postings"], F.lit(0).cast("long"),
                                 lambda n, p: n + F.size(F.array_intersect(s, _starts(hits, p)))).cast("double"),
                     (F.size(s) * F.size(template["postings"])).cast("double")).alias("share"))), F.lit(0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", library: tuple[Template, ...] = LIBRARY,
                  rare_words: int = RARE_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, n_words, matches) for each row of ``docs``; null and empty texts have no words.

    ``matches`` has (label, base, starts, share) for each template found, in the library's order: the word positions
    where it starts (below 0 where a file begins in its middle), and the mean share of its words that stand in
    place there. Statements other than base phrases count from ``min_share`` on. Repeated rows and ids are scanned each on
    its own; an empty table gives no rows.
    """
    rare_words = max(1, rare_words)
    files = as_table(licence_words(docs, id_col, text_col, library))
    seen = files.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").count()
    index = _index(library, dict(seen.collect()))  # at most one row a word of the library
    files = files.withColumn("own", F.array_distinct(F.col("hits.word")))
    hits, own = F.col("hits"), F.col("own")
    wanted = F.filter(index, lambda t: F.forall(t["keys"], lambda k: F.array_contains(own, k["word"])))
    found = F.transform(wanted, lambda t: _match(hits, own, t, rare_words))
    good = F.filter(found, lambda m: (F.size(m["starts"]) > 0) & (m["base"] | (m["share"] >= min_share)))
    return files.select("id", "n_words", good.cast(_MATCHES).alias("matches"))
