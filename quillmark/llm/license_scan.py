"""Licence detection: phrases by words, and ordered signature rules."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import text_bytes

#: The base: words that have to stand one after the other, and the label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: (keyword, label, priority, patterns).  The texts that the patterns read are
#: the lower-cased words joined by single spaces; "licen[sc]e" has both
#: spellings.  Within an overlap a detection of higher priority stays, and of
#: equal priorities the one whose interval contains the other.
_VERSIONED = (  # keyword, label stem, how the name is written, versions
    ("general public", "gpl", r"(?:gnu )?general public licen[sc]e", ("1", "2", "3")),
    ("gpl", "gpl", r"gnu gpl|(?<![al])gpl", ("1", "2", "3")),
    ("general public", "lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2", "2 1", "3")),
    ("lgpl", "lgpl", r"lgpl", ("2", "2 1", "3")),
    ("affero", "agpl", r"(?:gnu )?affero general public licen[sc]e", ("1", "3")),
    ("agpl", "agpl", r"agpl", ("1", "3")),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ("1", "1 1", "2")),
    ("mozilla", "mpl", r"mozilla public licen[sc]e", ("1", "1 1", "2")),
    ("mpl", "mpl", r"mpl", ("1", "1 1", "2")),
    ("eclipse", "epl", r"eclipse public licen[sc]e", ("1", "2")),
    ("epl", "epl", r"epl", ("1", "2")),
    ("common development", "cddl", r"common development and distribution licen[sc]e", ("1", "1 1")),
    ("european union", "eupl", r"european union public licen[sc]e", ("1 1", "1 2")),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1", "2")),
    ("academic free", "afl", r"academic free licen[sc]e", ("1 1", "2", "2 1", "3")),
    ("open software", "osl", r"open software licen[sc]e", ("1", "2", "2 1", "3")),
    ("boost", "bsl", r"boost software licen[sc]e", ("1",)),
    ("free documentation", "gfdl", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("open font", "ofl", r"(?:sil )?open font licen[sc]e", ("1", "1 1")),
    ("zope", "zpl", r"zope public licen[sc]e", ("1 1", "2", "2 1")),
    ("php", "php", r"php licen[sc]e", ("3", "3 01")),
    ("python", "psf", r"python software foundation licen[sc]e", ("2",)),
    ("common public", "cpl", r"common public licen[sc]e", ("1",)),
    ("open database licen", "odbl", r"open data(?:base)? commons open database licen[sc]e", ("1",)),
    ("server side public", "sspl", r"server side public licen[sc]e", ("1",)),
    ("business source", "busl", r"business source licen[sc]e", ("1 1",)),
    ("microsoft", "ms-pl", r"microsoft public licen[sc]e", ("1",)),
    ("lucent", "lpl", r"lucent public licen[sc]e", ("1", "1 02")),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e", ("1",)),
    ("reciprocal", "rpl", r"reciprocal public licen[sc]e", ("1 1", "1 5")),
)
_CC_PARTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
_CC_NAMES = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s(?: works)?",
    "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
}
_SINGLE = (  # keyword, label, priority, pattern
    ("mit licen", "mit", 50, r"(?:the )?mit licen[sc]e"),
    ("mit licen", "mit", 60, r"(?:released|licen[sc]ed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e"),
    ("free of charge to any person", "mit", 70, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("x11", "x11", 50, r"x11 licen[sc]e"),
    ("expat", "mit", 50, r"expat licen[sc]e"),
    ("bsd", "bsd", 40, r"bsd (?:style )?licen[sc]e"),
    ("bsd", "bsd-2-clause", 60, r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?"),
    ("bsd", "bsd-2-clause", 60, r"bsd (?:2|two) clause(?: licen[sc]e)?"),
    ("bsd", "bsd-3-clause", 60, r"(?:modified|new|revised|3 clause|three clause) bsd(?: licen[sc]e)?"),
    ("bsd", "bsd-3-clause", 60, r"bsd (?:3|three) clause(?: licen[sc]e)?"),
    ("bsd", "bsd-4-clause", 60, r"(?:original|old|4 clause|four clause) bsd(?: licen[sc]e)?"),
    ("bsd", "0bsd", 60, r"(?:zero clause|0 clause) bsd|0bsd"),
    ("redistribution and use", "bsd", 70, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc licen", "isc", 50, r"isc licen[sc]e"),
    ("permission to use copy modify", "isc", 55, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("zlib", "zlib", 50, r"zlib(?: libpng)? licen[sc]e"),
    ("unlicense", "unlicense", 50, r"(?:the )?unlicense"),
    ("public domain", "public-domain", 50, r"(?:released |placed |dedicated |is )?(?:in|into|to)(?: the)? public domain"),
    ("unencumbered", "unlicense", 70, r"free and unencumbered software released into the public domain"),
    ("cc0", "cc0-1.0", 60, r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("wtfpl", "wtfpl", 50, r"wtfpl"),
    ("beerware", "beerware", 50, r"beerware(?: licen[sc]e)?"),
    ("postgresql", "postgresql", 50, r"postgresql licen[sc]e"),
    ("ncsa", "ncsa", 50, r"ncsa(?: open source)? licen[sc]e"),
    ("openssl", "openssl", 50, r"openssl licen[sc]e"),
    ("curl", "curl", 50, r"curl licen[sc]e"),
    ("ruby", "ruby", 50, r"ruby licen[sc]e"),
    ("vim", "vim", 50, r"vim licen[sc]e"),
    ("json", "json", 50, r"json licen[sc]e"),
    ("icu", "icu", 50, r"icu licen[sc]e"),
    ("unicode", "unicode", 50, r"unicode(?: inc)? licen[sc]e"),
    ("intel", "intel", 50, r"intel open source licen[sc]e"),
    ("w3c", "w3c", 50, r"w3c (?:software )?(?:notice and )?licen[sc]e"),
    ("creative commons", "cc", 20, r"creative commons(?: licen[sc]e)?"),
    ("all rights reserved", "all-rights-reserved", 30, r"all rights reserved"),
    ("proprietary", "proprietary", 30, r"proprietary (?:and confidential|licen[sc]e|software)"),
    ("open government", "ogl", 50, r"open government licen[sc]e(?: v(?:ersion)? ?[123])?"),
    ("blue oak", "blueoak", 50, r"blue oak model licen[sc]e"),
    ("mulan", "mulan-psl", 50, r"mulan (?:permissive software|psl)(?: licen[sc]e)?"),
    ("educational community", "ecl", 50, r"educational community licen[sc]e"),
    ("you want to public licen", "wtfpl", 40, r"do what(?:ever)? (?:the f\w+ )?you want to public licen[sc]e"),
    ("elastic licen", "elastic", 50, r"elastic licen[sc]e(?: 2(?: 0)?)?"),
    ("llama", "llama", 50, r"llama (?:2|3|3 1|3 2|3 3)? ?community licen[sc]e"),
    ("responsible ai", "openrail", 50, r"responsible ai licen[sc]e"),
    ("rail", "openrail", 50, r"open ?rail(?: m)?"),
)
_UNDER = r"(?:under (?:the )?(?:terms of (?:the )?)?)?"
#: Identifiers of licences without versions, as words, and their labels.
_IDENTIFIERS = (
    ("mit", "mit"), ("isc", "isc"), ("0bsd", "0bsd"), ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("bsd 4 clause", "bsd-4-clause"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("x11", "x11"),
    ("wtfpl", "wtfpl"), ("cc0 1 0", "cc0-1.0"), ("ncsa", "ncsa"), ("openssl", "openssl"), ("curl", "curl"), ("ruby", "ruby"), ("vim", "vim"), ("json", "json"), ("icu", "icu"), ("postgresql", "postgresql"), ("beerware", "beerware"), ("w3c", "w3c"),
)
_SPDX = "spdx licen[sc]e identifier"


def signature_rules() -> list[tuple[str, str, int, re.Pattern]]:
    """(keyword, label, priority, pattern) in order; several hundred.

    A versioned licence has one rule for its bare name, and for each version one
    for the name before it, one for "or later", one for the short form with its
    number joined or apart and one for its identifier; Creative Commons has them
    by part, version and spelling.
    """
    out = []
    add = lambda keyword, label, priority, pattern: out.append((keyword, label, priority, re.compile(rf"(?<= ){pattern}(?= )")))
    later = "(?:or (?:at your option )?(?:any )?later(?: version)?|or newer)"
    short: dict[str, tuple] = {}
    for keyword, stem, name, versions in _VERSIONED:
        add(keyword, stem, 40, f"{_UNDER}(?:the )?(?:{name})")
        for version in versions:
            number = version if " " in version else f"{version}(?: 0)?"
            label = f"{stem}-{version.replace(' ', '.')}"
            add(keyword, label, 60, f"{_UNDER}(?:the )?(?:{name}) (?:version |v ?)?{number}(?! [0-9] )")
            add(keyword, f"{label}-or-later", 70, rf"{_UNDER}(?:the )?(?:{name}) (?:version |v ?)?{number} {later}")
        short[stem] = versions
    for stem, versions in short.items():
        word = stem.replace("-", " ")
        for version in versions:
            label, full = f"{stem}-{version.replace(' ', '.')}", version if " " in version else f"{version} 0"
            number = version if " " in version else f"{version}(?: 0)?"
            add(word, label, 62, rf"(?:{word} v|{word}v ?){number}(?! [0-9] )")
            add(word, f"{label}-or-later", 72, rf"(?:{word} v|{word}v ?){number} (?:{later}|plus)")
            add(word, label, 62, rf"{word} {full}(?: only)?")
            add(word, f"{label}-or-later", 72, rf"{word} {full} or later")
            add(word, label, 64, rf"{_SPDX} {word} {full}(?: only)?")
            add(word, f"{label}-or-later", 74, rf"{_SPDX} {word} {full} or later")
    for words, label in _IDENTIFIERS:
        add("spdx", label, 64, f"{_SPDX} {words}")
    for parts in _CC_PARTS:
        label, name = "cc-" + parts.replace(" ", "-"), _CC_NAMES[parts]
        versions = ("1 0", "2 0", "2 5", "3 0", "4 0")
        add(f"cc {parts}", label, 45, f"cc {parts}(?! (?:nc|sa|nd) )(?: licen[sc]e)?")
        add(f"creative commons {parts}", label, 45, f"creative commons {parts}(?! (?:nc|sa|nd) )(?: licen[sc]e)?")
        # "attribution" is a word of its own: only beside the name, the word licence or a version's scope
        add("creative commons attribution", label, 45, f"creative commons {name}(?! (?:non|no|share))(?: licen[sc]e)?")
        add("attribution", label, 45, f"{name} licen[sc]e")
        for version in versions:
            full, scope = f"{label}-{version.replace(' ', '.')}", "(?: international| unported| generic)"
            add(f"cc {parts}", full, 65, f"cc {parts} (?:licen[sc]e )?(?:version |v ?)?{version}{scope}?")
            add(f"creative commons {parts}", full, 65, f"creative commons {parts} (?:licen[sc]e )?(?:version |v ?)?{version}{scope}?")
            add("creative commons attribution", full, 65, f"creative commons {name} (?:licen[sc]e )?(?:version |v ?)?{version}{scope}?")
            add("attribution", full, 65, f"{name} licen[sc]e (?:version |v ?)?{version}{scope}?")
            add("attribution", full, 65, f"{name} {version}{scope}")
    for keyword, label, priority, pattern in _SINGLE:
        add(keyword, label, priority, pattern)
    return out


_CLASS = bytes(0x20 if c < 0x30 or 0x3A <= c < 0x41 or 0x5B <= c < 0x61 or 0x7B <= c < 0x80 else c + 0x20 if 0x41 <= c < 0x5B else c for c in range(256))


class Scanner:
    """Base places and rule detections of one text."""

    def __init__(self, phrases=PHRASES):
        import ahocorasick

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.rules = signature_rules()
        self.keywords = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, (keyword, *_) in enumerate(self.rules):
            by_keyword.setdefault(keyword, []).append(i)
        for keyword, numbers in by_keyword.items():
            self.keywords.add_word(keyword, numbers)
        self.keywords.make_automaton()
        #: A text without a keyword and without a phrase has no detection.
        self.gate = ahocorasick.Automaton()
        for word in [*by_keyword, *(p.decode() for p, _ in self.phrases)]:
            self.gate.add_word(word, True)
        self.gate.make_automaton()

    def base(self, text: bytes) -> list[tuple[int, str]]:
        """(first word's number, label) of each place; words from 0."""
        found = []
        for phrase, label in self.phrases:
            at, before, words = text.find(phrase), 0, 0
            while at >= 0:
                words += text.count(b" ", before, at)
                before = at
                found.append((words, label))
                at = text.find(phrase, at + 1)
        return found

    def rule_hits(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, end, priority, label) that stay after suppression.

        Of two detections of which one's interval contains the other's, the one
        of higher priority stays, of equal ones the container, then the earlier
        rule.  Detections that overlap only in part both stay.
        """
        wanted = sorted({i for _, numbers in self.keywords.iter(text) for i in numbers})
        hits = []
        for i in wanted:
            _, label, priority, pattern = self.rules[i]
            hits += [(m.start(), m.end(), priority, label, i) for m in pattern.finditer(text)]
        # none of those kept contains another, so their ends are in order as their starts are
        starts: list[int] = []
        kept: list[tuple[int, int, int, str]] = []
        for start, end, priority, label, _ in sorted(hits, key=lambda h: (-h[2], h[0] - h[1], h[0], h[4])):
            at = bisect_right(starts, start)
            if at and kept[at - 1][1] >= end:
                continue
            inner = bisect_left(starts, start)
            if inner < len(kept) and kept[inner][1] <= end:
                continue
            starts.insert(at, start)
            kept.insert(at, (start, end, priority, label))
        return kept

    def __call__(self, raw: bytes) -> tuple:
        words = raw.translate(_CLASS).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        text = b" " + b" ".join(words) + b" "
        if next(self.gate.iter(text.decode("utf-8", "replace")), None) is None:
            return len(words), 0, None, None, "", "", 0.0, []
        places = self.base(text)
        hits = self.rule_hits(text.decode("utf-8", "replace"))
        base = {label for _, label in places}
        labels = base | {h[3] for h in hits}
        starts = [p for p, _ in places]
        evidence = sum(h[2] for h in hits) / 100 + len(places)
        score = 1 - 0.5**evidence if labels else 0.0
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, hits


def scan_licenses(docs: DataFrame, phrases=PHRASES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base places, labels, score and the rules' detections of every text.

    detections are structs (start, end, priority, label) in the lower-cased
    words joined by single spaces.  score is 1 - 0.5 ** evidence, a base place
    counting 1 and a detection its priority / 100.  A null text is empty: no
    words, no labels, score 0.  One pass without shuffle; rows keep their ids
    as they are, null or repeated; a long text is read whole, in time that
    follows its length and its detections; an empty table gives no rows.
    """

    def run(batches):
        scan = Scanner(phrases)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            found = [scan(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = list(zip(*found)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), hit]
            values = [pa.array(c, k) for c, k in zip(columns[:7], kinds)]
            values.append(pa.array([[dict(zip(("start", "end", "priority", "label"), h)) for h in c] for c in columns[7]], hit))
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int64()), ("label", pa.string())]))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: long, end: long, priority: long, label: string>>")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base places and labels, and the rules' labels and score."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
