"""License scans by ordered signature rules, in DataFrame functions alone.

1. A text's A-Z are lower-cased and its words set between spaces of their own.
2. Families of licenses have keywords; the rules of those of which a text holds a
   keyword are tried on it, and no others.
3. Each rule is a regular expression over whole words, with a label and a priority;
   its matches are intervals of words.
4. An interval that lies in one of a better or equal priority goes, so a mention
   inside a title, or a title inside a grant, counts once. The base phrases stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed: what separates words, and what A-Z becomes.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed: base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families: label, keywords of which a text must hold one, and the names it goes by, as words with alternatives.
FAMILIES = [
    ("agpl", "affero|agpl", "(?:gnu )?affero (?:general )?public licen[cs]e|gnu agpl|agplv[13]|agpl"),
    ("lgpl", "lesser general|library general|lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl|lgplv[23]|lgpl"),
    ("gpl", "gpl|general public", "(?:gnu )?general public licen[cs]e|gnu gpl|gplv[123]|gpl"),
    ("gfdl", "free documentation|gfdl", "(?:gnu )?free documentation licen[cs]e|gfdl"),
    ("apache", "apache", "apache software licen[cs]e|apache licen[cs]e|apache 2|apache"),
    ("mit", " mit ", "mit x11 licen[cs]e|mit licen[cs]e|mit style licen[cs]e|mit"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[cs]e|bsd 2 clause"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e|bsd 3 clause"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd) licen[cs]e|bsd 4 clause"),
    ("bsd", "bsd", "bsd (?:style )?licen[cs]e|bsd"),
    ("isc", " isc |internet systems", "isc licen[cs]e|internet systems consortium licen[cs]e"),
    ("mpl", "mozilla| mpl", "mozilla public licen[cs]e|mplv[12]|mpl 2"),
    ("epl", "eclipse| epl ", "eclipse public licen[cs]e|epl 2"),
    ("edl", "eclipse", "eclipse distribution licen[cs]e"),
    ("cddl", "common development|cddl", "common development and distribution licen[cs]e|cddl"),
    ("cpl", "common public", "common public licen[cs]e"),
    ("eupl", "european union|eupl", "european union public licen[cs]e|eupl"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("perl", " perl ", "same terms as perl itself|perl licen[cs]e"),
    ("psf", "python| psf ", "python software foundation licen[cs]e|psf licen[cs]e|python licen[cs]e"),
    ("php", " php ", "php licen[cs]e"),
    ("ruby", " ruby ", "ruby licen[cs]e|same terms as ruby"),
    ("zlib", "zlib", "zlib libpng licen[cs]e|zlib licen[cs]e"),
    ("openssl", "openssl|ssleay", "openssl licen[cs]e|ssleay licen[cs]e"),
    ("boost", "boost| bsl ", "boost software licen[cs]e|bsl 1"),
    ("unlicense", "unlicen", "unlicen[cs]e"),
    ("wtfpl", "wtfpl|what the fuck", "do what the fuck you want to public licen[cs]e|wtfpl"),
    ("cc0", "cc0|commons zero", "creative commons zero|cc0 1 0|cc0"),
    ("cc-by-nc-nd", "creative commons| cc by ", "(?:creative commons attribution|cc by) (?:non ?commercial|nc) (?:no ?deriv(?:ative)?s?|nd)(?: works)?"),
    ("cc-by-nc-sa", "creative commons| cc by ", "(?:creative commons attribution|cc by) (?:non ?commercial|nc) (?:share ?alike|sa)"),
    ("cc-by-nc", "creative commons| cc by ", "(?:creative commons attribution|cc by) (?:non ?commercial|nc)"),
    ("cc-by-nd", "creative commons| cc by ", "(?:creative commons attribution|cc by) (?:no ?deriv(?:ative)?s?|nd)(?: works)?"),
    ("cc-by-sa", "creative commons| cc by ", "(?:creative commons attribution|cc by) (?:share ?alike|sa)"),
    ("cc-by", "creative commons| cc by ", "creative commons attribution|cc by"),
    ("public-domain", "public domain", "public domain"),
    ("odbl", "database|odbl", "open (?:data commons open )?database licen[cs]e|odbl"),
    ("pddl", "dedication|pddl", "public domain dedication and licen[cs]e|pddl"),
    ("ofl", "font", "sil open font licen[cs]e|open font licen[cs]e"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("sspl", "server side|sspl", "server side public licen[cs]e|sspl"),
    ("busl", "business source", "business source licen[cs]e"),
    ("elastic", "elastic", "elastic licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("vim", " vim ", "vim licen[cs]e"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[cs]e"),
    ("ncsa", "illinois", "university of illinois ncsa open source licen[cs]e|ncsa licen[cs]e"),
    ("ecl", "educational", "educational community licen[cs]e"),
    ("afl", "academic", "academic free licen[cs]e"),
    ("osl", "open software", "open software licen[cs]e"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: licen[cs]e)?"),
    ("mulan", "mulan", "mulan (?:psl|permissive software licen[cs]e)"),
    ("commercial", "commercial", "commercial licen[cs]e|commercial use only"),
    ("proprietary", "proprietary|rights reserved", "proprietary (?:software )?licen[cs]e|proprietary and confidential|all rights reserved"),
]
#: Templates: name, priority (1 is best), and the expression around a family's name {n}.
TEMPLATES = [
    ("identifier", 1, "spdx licen[cs]e identifier (?:{n})(?: only| or later)?(?: v?[0-9]+(?: [0-9]+)?)?"),
    ("grant", 2, "(?:licen[cs]ed|released|distributed|available|provided|published|redistributed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{n})(?: (?:version )?v?[0-9]+(?: [0-9]+)?)?(?: or (?:any|at your option any) later version)?"),
    ("reference", 2, "(?:see|read|accept|subject to|governed by|covered by|agree to|terms of) (?:the )?(?:{n})(?: for (?:more )?details| (?:version )?v?[0-9]+(?: [0-9]+)?)?"),
    ("version", 3, "(?:{n})(?: international)? (?:version |v)?[0-9]+(?: [0-9]+)?(?: (?:international|unported|or later))?"),
    ("mention", 4, "(?:{n})"),
]
#: How sure a rule of each priority is that a text bears a license, and a base phrase alone.
WEIGHTS, PRIORITIES = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.5}, (1, 2, 3, 4)


def over_words(pattern: str) -> str:
    """A pattern with single spaces, over words that stand between two: ` mit  license `."""
    wide = pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    return f" (?:{wide}) "


def rules() -> list[tuple[int, str, str, int, str, str]]:
    """(number, rule, label, priority, keyword, pattern): the base phrases, numbered from 0, then every family's templates."""
    found = [("base", label, 4, phrase, over_words(phrase)) for phrase, label in BASE.items()]
    found += [(kind, label, priority, keyword, over_words(body.format(n=names))) for label, keyword, names in FAMILIES for kind, priority, body in TEMPLATES]
    return [(i, *r) for i, r in enumerate(found)]


def keywords(of: str) -> list[str]:
    """The keywords of a rule, as parts of a spaced text."""
    return [k.replace(" ", "  ") if k.strip() == k else f" {k.strip().replace(' ', '  ')}{' ' if k.endswith(' ') else ''}" for k in of.split("|")]


def spaced(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, each between two spaces of its own; without words, an empty string."""
    words = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words(spaced_text: Column) -> Column:
    """The number of words of a spaced text, or of a part of one that has whole words."""
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _matches(text: Column, rule: Column) -> Column:
    """array<struct<start, stop>>: the words that each match of a rule spans."""
    gaps, hits = F.split(text, rule["pattern"], -1), F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    counts = F.zip_with(F.transform(F.slice(gaps, 1, F.size(hits)), _words), F.transform(hits, _words), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    empty = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(s: Column, c: Column) -> Column:
        start = s["at"] + c["gap"]
        stop = start + c["hit"]
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("out"))

    return F.aggregate(counts, first, step, lambda s: s["out"])


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, rule, label, priority, base, start, stop, kept): the matches of all rules in docs (doc_id, text), one row with a null rule for a row without any.

    row tells rows apart that share a doc_id. start and stop (not included) count
    words. kept is false for a match that lies in another one of a better priority,
    or in a longer one of its own; of equal ones, the rule of the smaller number
    stays. Null and empty texts have no words; other columns are not read.
    """
    by: dict[str, list[Column]] = {}
    for i, kind, label, p, keyword, pattern in rules():
        by.setdefault(keyword, []).append(F.struct(F.lit(i).alias("no"), F.lit(kind).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(pattern).alias("pattern")))
    table = F.array(*[F.struct(F.array(*[F.lit(k) for k in keywords(words)]).alias("keywords"), F.array(*own).alias("rules")) for words, own in by.items()])
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), spaced(F.coalesce("text", F.lit(""))).alias("t"))
    gate = F.lit(False)
    for word in sorted({k for words in by for k in keywords(words)}):
        gate = gate | F.contains("t", F.lit(word))
    tried = F.flatten(F.transform(F.filter(table, lambda f: F.exists(f["keywords"], lambda k: F.contains(F.col("t"), k))), lambda f: f["rules"]))
    texts = texts.select("row", "doc_id", _words(F.col("t")).alias("n_words"), F.when(gate, F.col("t")).alias("t"))
    each = texts.select("row", "doc_id", "n_words", "t", F.explode_outer(F.when(F.col("t").isNotNull(), tried)).alias("r"))
    hits = each.select("row", "doc_id", "n_words", "r.no", "r.rule", "r.label", "r.priority", F.explode_outer(F.when(F.col("r").isNotNull(), _matches(F.col("t"), F.col("r")))).alias("m"))
    hits = hits.select("row", "doc_id", "n_words", "no", F.when(F.col("m").isNotNull(), F.col("rule")).alias("rule"), "label", "priority", "m.start", "m.stop")
    order = W.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "no").rowsBetween(W.unboundedPreceding, -1)
    for p in PRIORITIES:
        hits = hits.withColumn(f"_stop{p}", F.max(F.when(F.col("priority") == p, F.col("stop"))).over(order))
    inside = F.lit(False)
    for p in PRIORITIES:
        inside = inside | ((F.col("priority") >= p) & (F.col(f"_stop{p}") >= F.col("stop")))
    kept = F.col("rule").isNotNull() & ~F.coalesce(inside, F.lit(False))
    return hits.select("row", "doc_id", "n_words", "rule", "label", "priority", (F.col("rule") == "base").alias("base"), "start", "stop", kept.alias("kept"))


def license_labels(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, whose smallest and largest first words
    follow (null without any); base_labels and labels (of kept matches, and the base
    ones) are distinct, sorted and comma-joined, or empty. score is 1 less the
    product of what each kept label's best rule leaves open. Rows that repeat a
    doc_id, and those with a null one, are scanned like any other; an empty table
    gives an empty result.
    """
    found = scan(docs)
    base = F.coalesce("base", F.lit(False))
    weight = F.coalesce(*[F.when(F.col("priority") == p, F.lit(w)) for p, w in WEIGHTS.items()])
    one = found.groupBy("row", "doc_id", "n_words", F.when(F.col("kept") | base, F.col("label")).alias("label")).agg(
        F.count_if(base).alias("n"), F.min(F.when(base, F.col("start"))).alias("first"), F.max(F.when(base, F.col("start"))).alias("last"), F.max(F.when(F.col("kept") | base, weight)).alias("w"),
    )
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    rest = F.aggregate(F.sort_array(F.collect_list("w")), F.lit(1.0), lambda s, w: s * (1 - w))
    return one.groupBy("row", "doc_id", "n_words").agg(
        F.sum("n").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        joined(F.when(F.col("n") > 0, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.round(1 - rest, 6).alias("score"),
    ).drop("row")
