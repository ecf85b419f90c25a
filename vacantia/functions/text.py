"""Text expressions.  All functions take and return a Column and stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import rules

# Java's \w and \s are ASCII by default.  These classes spell out the Unicode meaning: letters, numbers and
# underscore; all white space including the separators 0x1c-0x1f.  RE2 reads them the same way.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
# The same characters one by one, for trimming without a regular expression.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it several times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, trimmed.  Texts without such runs are told by a cheaper test and stay as they are."""

    def collapsed(t: Column) -> Column:
        plain = ~F.contains(t, F.lit("  ")) & ~t.rlike(r"[^ -~\x{a1}-\x{24f}]")
        return F.trim(F.when(plain, t).otherwise(F.regexp_replace(t, f"{SPACE}+", " ")))

    return let(text, collapsed)


def clean_text(text: Column) -> Column:
    """NUL to space, trim, collapse white space, empty to null."""
    return blank_to_null(collapse_spaces(F.translate(text, "\x00", " ")))


def trim_text(text: Column) -> Column:
    """Trim, empty to null; inner white space stays."""
    return blank_to_null(strip(text))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substr(run, F.lit(2)))), ""
    )


def city_of(location: Column) -> Column:
    """Text before the first comma, title-cased."""
    return title_case(trim_text(F.split_part(trim_text(location), F.lit(","), F.lit(1))))


def lower_label(text: Column) -> Column:
    return F.lower(trim_text(text))


def seniority_label(text: Column, synonyms: dict[str, str] | None = None) -> Column:
    table = rules.SENIORITY_SYNONYMS if synonyms is None else synonyms
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    trimmed = trim_text(text)
    return F.coalesce(F.try_element_at(lookup, F.lower(trimmed)), title_case(trimmed))


def clean_description(text: Column) -> Column:
    """Lower-case text of words, spaces, '-', '.' and '/' only; null gives ''."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\-./]+", " ")
    return F.coalesce(F.trim(kept), F.lit(""))


def word_list(text: Column) -> Column:
    """Words of the lower-case text in order, with repeats."""
    return F.filter(F.split(F.lower(text), NOT_WORD + "+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.coalesce(word_list(text), F.array().cast("array<string>")))


def _quote(phrase: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in phrase)


def any_phrase_pattern(phrases: list[str]) -> str:
    return "|".join(_quote(p) for p in phrases)


def whole_word_pattern(phrases: list[str]) -> str:
    return f"(?<!{WORD})(?:{any_phrase_pattern([p.strip() for p in phrases])})(?!{WORD})"


def seniority_from_text(
    level: Column, title: Column, description: Column, rule_list: list[dict] | None = None, whole_words: bool = False,
    description_chars: int | None = rules.DESCRIPTION_CHARS_FOR_SENIORITY,
) -> Column:
    """First rule that matches level + title; the start of the description (None: all of it) only when both are empty."""
    head = F.lower(F.concat_ws(" ", clean_text(level), clean_text(title)))
    whole = clean_text(description)
    body = F.lower(whole if description_chars is None else F.substring(whole, 1, description_chars))
    text = F.coalesce(blank_to_null(head), body)
    result = None
    for rule in rules.SENIORITY_RULES if rule_list is None else rule_list:
        phrases, words = list(rule["phrases"]), list(rule["words"])
        if whole_words:
            phrases, words = [], phrases + words
        patterns = [any_phrase_pattern(phrases)] if phrases else []
        patterns += [whole_word_pattern(words)] if words else []
        hit = text.rlike("|".join(patterns))
        result = F.when(hit, rule["label"]) if result is None else result.when(hit, rule["label"])
    return result


def category_from_title(title: Column, groups: dict[str, list[str]] | None = None, whole_words: bool = False) -> Column:
    text = F.lower(F.coalesce(clean_text(title), F.lit("")))
    pattern = whole_word_pattern if whole_words else any_phrase_pattern
    result = None
    for label, phrases in (rules.ROLE_PHRASES if groups is None else groups).items():
        hit = text.rlike(pattern(phrases))
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise("other")


def is_tech_title(title: Column, words: list[str] | None = None, whole_words: bool = False) -> Column:
    pattern = whole_word_pattern if whole_words else any_phrase_pattern
    text = F.lower(F.coalesce(clean_text(title), F.lit("")))
    return text.rlike(pattern(rules.TECH_TITLE_WORDS if words is None else words))


def _ascii_words(phrase: str) -> list[str]:
    """Words without which the phrase is in no text as a whole word; none if it is not plain ASCII."""
    return list(dict.fromkeys(re.findall(r"[A-Za-z0-9_]+", phrase))) if phrase.isascii() else []


def detect_skills(text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Sorted distinct skills with at least one phrase in the text, as array<string>.

    A one-word phrase is looked up among the distinct words of the text, which costs one pass for all of
    them.  Of a longer phrase all words are looked up first; only texts that have them are searched for the phrase.
    """
    table = rules.SKILL_LEXICON if lexicon is None else lexicon
    single: dict[str, list[str]] = {}
    several: dict[str, list[str]] = {}
    for skill, phrases in table.items():
        for phrase in phrases:
            if phrase.replace("_", "").isalnum():
                single.setdefault(phrase, []).append(skill)
            else:
                several.setdefault(skill, []).append(phrase)
    pieces = {p: _ascii_words(p) for phrases in several.values() for p in phrases}
    sought = list(dict.fromkeys([*single, *(w for words in pieces.values() for w in words)]))
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def tags(t: Column) -> Column:
        words = F.array_intersect(F.array(*[F.lit(p) for p in sought]).cast("array<string>"), F.split(t, NOT_WORD + "+"))
        return let(words, lambda held: tags_of(t, held))

    def tags_of(t: Column, held: Column) -> Column:
        found = F.array_intersect(F.array(*[F.lit(p) for p in single]), held)
        by_word = F.create_map(
            *[x for p, skills in single.items() for x in (F.lit(p), F.array(*[F.lit(s) for s in skills]))]
        )
        parts = [F.flatten(F.transform(found, lambda word: F.element_at(by_word, word)))]
        if several:
            hits = []
            for skill, phrases in several.items():
                hit = F.lit(False)
                for phrase in phrases:
                    there = F.contains(t, F.lit(phrase)) & t.rlike(whole_word_pattern([phrase]))
                    for word in reversed(pieces[phrase]):
                        there = F.array_contains(held, word) & there
                    hit = hit | there
                hits.append(F.when(hit, skill))
            parts.append(F.array_compact(F.array(*hits)))
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    return let(lowered, tags)


def sentences(text: Column) -> Column:
    """Sentences of the text after collapsing white space; null or blank gives an empty array."""
    flat = F.coalesce(collapse_spaces(text), F.lit(""))
    return F.filter(F.split(flat, r"(?<=[.!?]) "), lambda s: s != "")


def merge_short(items: Column, minimum: int = rules.MIN_SENTENCE_CHARS) -> Column:
    """Join runs of short sentences; a short run at the end joins the sentence before it.

    Sentences hold no line feed, so one joined text split at line feeds does it in linear time.
    """

    def is_short(s: Column) -> Column:
        return F.length(s) < minimum

    def merged(s: Column) -> Column:
        last_long = F.array_max(F.transform(s, lambda x, i: F.when(is_short(x), -1).otherwise(i)))

        def joined(last: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                glued = (is_short(x) & is_short(F.get(s, i - 1))) | ((i == last + 1) & (last >= 0))
                return F.when(i == 0, x).when(glued, F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit("\n"), x))

            return F.split(F.array_join(F.transform(s, piece), ""), "\n")

        return F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(let(last_long, joined))

    return let(items, merged)


def pack_chunks(
    items: Column, maximum: int = rules.MAX_CHUNK_CHARS, minimum: int = rules.MIN_CHUNK_CHARS, overlap: int = 1
) -> Column:
    """Pack sentences into passages of at most `maximum` characters, repeating the last `overlap` sentences.

    The limit is soft: a sentence longer than it is not split, and repeated sentences may exceed it.  The fold
    carries numbers only (where a passage starts); starts are kept in blocks so that long texts stay cheap.
    """
    if overlap not in (0, 1):
        raise ValueError("overlap must be 0 or 1")
    block = 256

    def starts_of(e: Column) -> Column:
        empty_int = F.array().cast("array<int>")
        first = F.struct(
            F.array().cast("array<array<int>>").alias("done"),
            empty_int.alias("part"),
            F.lit(0).alias("i"),
            F.lit(-1).alias("size"),
            F.lit(0).alias("last"),
        )

        def step(acc: Column, s: Column) -> Column:
            size = F.length(s)
            fits = (acc["size"] + 1 + size <= maximum) | (acc["size"] < 0)
            full = F.size(acc["part"]) >= block
            return F.struct(
                F.when(~fits & full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
                F.when(fits, acc["part"])
                .when(full, F.array(acc["i"]))
                .otherwise(F.concat(acc["part"], F.array(acc["i"])))
                .alias("part"),
                (acc["i"] + 1).alias("i"),
                F.when(fits, acc["size"] + 1 + size)
                .otherwise(acc["last"] + 1 + size if overlap else size)
                .alias("size"),
                size.alias("last"),
            )

        return F.aggregate(
            e,
            first,
            step,
            lambda acc: F.concat(F.array(F.lit(0)), F.flatten(acc["done"]), acc["part"]),
        )

    def chunks(e: Column) -> Column:
        def cut(starts: Column) -> Column:
            def passage(start: Column, j: Column) -> Column:
                begin = F.when(j == 0, start).otherwise(start - overlap)
                end = F.coalesce(F.get(starts, j + 1), F.size(e))
                return F.array_join(F.slice(e, begin + 1, end - begin), " ")

            return F.transform(starts, passage)

        packed = F.filter(let(starts_of(e), cut), lambda c: F.length(c) >= minimum)
        return F.when(F.size(e) == 0, F.array().cast("array<string>")).otherwise(packed)

    return let(items, chunks)  # bound outside of the test, or the sentences would be cut twice


def chunk_text(text: Column) -> Column:
    """Overlapping passages of a text as array<string>."""
    return pack_chunks(merge_short(sentences(text)))


def answer_sentences(text: Column) -> Column:
    """Sentences for answers: line feeds separate as well."""
    parts = F.split(strip(text), rf"(?<=[.!?]){SPACE}+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def term_list(text: Column, stopwords: list[str] | None = None) -> Column:
    """Candidate terms of a text in order: ASCII words (with - + .) of three or more characters."""
    edge = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"{edge}[a-zA-Z][a-zA-Z\-+.]+{edge}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in (rules.TERM_STOPWORDS if stopwords is None else stopwords)])
    return F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def question_type(question: Column) -> Column:
    q = F.lower(question)
    skills = F.contains(q, F.lit("skill")) | F.contains(q, F.lit("common requirements")) | F.contains(
        q, F.lit("common qualifications")
    )
    jobs = F.startswith(q, F.lit("which")) | F.contains(q, F.lit("which jobs")) | F.contains(q, F.lit("what jobs"))
    return F.when(skills, "skills").when(jobs, "jobs").otherwise("general")


DATE_FORMATS = ("MM/dd/yyyy", "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy")


def parse_date(text: Column) -> Column:
    """Date as written in an ISO date, a date-time (any offset ignored) or one of DATE_FORMATS; else null."""
    trimmed = trim_text(text)
    return F.coalesce(
        trimmed.try_cast("timestamp_ntz").cast("date"), *[F.try_to_date(trimmed, fmt) for fmt in DATE_FORMATS]
    )


def listed_date(text: Column) -> Column:
    """UTC date of epoch milliseconds, else of a date text; anything else is null."""
    day_zero = F.lit("1970-01-01").cast("date")
    number = text.try_cast("double")
    from_number = F.when(
        F.abs(number) < F.lit(8.0e15), F.date_add(day_zero, F.floor(number / 86400000.0).cast("int"))
    )
    has_offset = text.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})\s*$")
    instant = F.unix_micros(trim_text(text).try_cast("timestamp"))
    in_utc = F.date_add(day_zero, F.floor(instant / F.lit(86400000000)).cast("int"))
    return F.when(number.isNotNull(), from_number).when(has_offset, in_utc).otherwise(parse_date(text))
