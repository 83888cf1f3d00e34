"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities of the HTML decoder, and the stop words of the tokenizer (English and Dutch).
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "eacute": "é", "egrave": "è", "uuml": "ü", "ouml": "ö", "auml": "ä",
    "szlig": "ß", "euro": "€", "pound": "£", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "middot": "·", "bull": "•",
}
STOP_WORDS = (
    "the a an and or but of to in on for with at by from is are was were be been it its this that these those as how why what when who "
    "we you i not can will has have had de het een van en op te is met voor naar over"
).split()
# Function words that tell English, Dutch and other languages apart.
ENGLISH = (
    "the a an and or but if then than this that these those to of in on for from with without by as at is are was were be been being it its they their them we our "
    "you your he she his her not no do does did can could will would should may might about into over under after before why how what when where who new says said "
    "more most some any all one two first last has have had"
).split()
DUTCH = (
    "de het een en of maar als dan dit dat deze die naar van in op voor met zonder bij is zijn was waren wordt worden niet geen ook om uit over onder na vóór waarom hoe "
    "wat wanneer waar wie nieuwe zegt meer meeste sommige alle eerste laatste heeft hebben had"
).split()
OTHER = "le la les un une et ou mais dans des du pour avec sans est sont pas que qui sur en el los las una y o pero del por con sin es son no der die das ein eine und oder aber von zu mit ist sind nicht im auf für".split()

#: Unicode's space separators (category Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(words)))


def trimmed(s: Column) -> Column:
    """Without Unicode's space separators at both ends, as SQL's trim has it. The characters are named: inside a lambda, Spark's trim without them takes the last character off some strings."""
    return F.trim(s, F.lit(SPACES))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " "))


def decode_entities(s: Column) -> Column:
    """Numeric entities (decimal and hexadecimal; those outside Unicode stay as they are) and named ones, in one pass: what an entity gives never becomes part of another."""
    def char(code: Column, raw: Column) -> Column:
        # code points beyond 255 are spelled in UTF-16, whose two halves make one character above 65535
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        wide = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
        return (F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(wide), "UTF-16BE"))
                .otherwise(F.concat(F.lit("&"), raw, F.lit(";"))))

    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(part: Column) -> Column:
        body = F.substring_index(part, ";", 1)
        digits = F.substring(body, 2, 18)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 12), 16, 10)).otherwise(digits).cast("decimal(20,0)")
        return F.when(body.startswith("#"), char(F.least(code, F.lit(0x110000)).cast("int"), body)).otherwise(F.element_at(named, F.lower(body)))

    parts = F.split(s, rf"&(?=(?:#[0-9]{{1,18}}|#[xX][0-9a-fA-F]{{1,12}}|(?i:{'|'.join(ENTITIES)}));)")
    tail = lambda p: F.concat(decoded(p), F.substring(p, F.instr(p, ";") + 1, F.length(p)))
    return F.when(s.contains("&"), F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), tail), ""))).otherwise(s)


def strip_html(s: Column) -> Column:
    """Comments, scripts and tags away; block tags become line breaks."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style"):
        s = F.regexp_replace(s, rf"(?is)<{tag}.*?</{tag}>", " ")
    s = F.regexp_replace(s, r"(?i)</?(p|div|br|li|tr|h[1-6]|blockquote|section|article)[^>]*>", "\n")
    s = decode_entities(F.regexp_replace(s, r"<[^>]+>", " "))
    s = F.regexp_replace(F.regexp_replace(s, "[ \t ]+", " "), "\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(s, r"^[ \n\t\r]+|[ \n\t\r]+$", ""))


def truncate(s: Column, most: int) -> Column:
    cut = F.substring(s, 1, most)
    space = F.when(F.instr(cut, " ") > 0, most - F.instr(F.reverse(cut), " ")).otherwise(-1)
    return F.when(F.length(s) <= most, s).otherwise(
        F.concat(F.rtrim(F.when(space > most * 0.6, F.substring(cut, F.lit(1), space)).otherwise(cut)), F.lit("…")))


def escape_xml(s: Column) -> Column:
    s = F.regexp_replace(F.coalesce(s, F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        s = F.replace(s, F.lit(char), F.lit(f"&{name};"))
    return s


def tokenize(s: Column) -> Column:
    """Lower-case ASCII tokens of three letters or more that aren't stop words; accents fold to their base letter."""
    plain = F.translate(F.lower(F.coalesce(s, F.lit(""))), ACCENTED, PLAIN)
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~F.array_contains(strings(STOP_WORDS), t))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def named_entities(s: Column) -> Column:
    """Lower-cased capitalised phrases of up to four words, and acronyms, of the first 4000 characters."""
    head = F.substring(F.coalesce(s, F.lit("")), 1, 4000)
    stop = strings(STOP_WORDS)
    phrases = F.filter(F.regexp_extract_all(head, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*){0,3})(?![A-Za-z0-9_])"), F.lit(1)),
                       lambda p: (F.length(p) >= 3) & (p.contains(" ") | ((F.length(p) >= 4) & ~F.array_contains(stop, F.lower(p)))))
    acronyms = F.regexp_extract_all(head, F.lit(r"(?<![A-Za-z0-9_])([A-Z]{2,6})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(phrases, acronyms), F.lower))


def n_words(s: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(s, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))


def reading_minutes(s: Column, per_minute: int = 230) -> Column:
    n = n_words(s)
    return F.when(n >= 40, F.greatest(F.lit(1), F.floor(n / per_minute + 0.5))).cast("int")


def excerpt(s: Column, most: int) -> Column:
    """Head (60 %) and tail of a long text, with a marker between."""
    head = int(most * 0.6)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(
        F.rtrim(F.substring(s, 1, head)), F.lit("\n[…]\n"), F.ltrim(F.substring(s, F.length(s) - (most - head) + 1, F.lit(most - head)))))


# Fixed value: what stands for the part that an excerpt leaves out.
OMITTED = "\n\n[... middle of the article omitted ...]\n\n"


def structural_excerpt(body: Column, most: int, head_share: float = 0.6) -> Column:
    """Struct (text, excerpted, omitted): opening and closing of a text longer than `most`, each cut at a paragraph break unless that loses too much of it."""
    room = max(0, most - len(OMITTED))
    head_room = int(room * head_share)
    tail_room = room - head_room

    def joined(parts: Column) -> Column:
        head, tail = parts["head"], parts["tail"]
        # places from 0; -1 where there is no break
        last = F.when(F.instr(F.reverse(head), "\n\n") > 0, F.length(head) - F.instr(F.reverse(head), "\n\n") - 1).otherwise(-1)
        first = F.instr(tail, "\n\n") - 1
        begin = F.when(last > head_room * 0.6, F.substring(head, F.lit(1), last)).otherwise(head)
        end = F.when((first >= 0) & (first < tail_room * 0.4), F.substring(tail, first + 3, F.length(tail))).otherwise(tail)
        return once(F.struct(begin.alias("b"), end.alias("e")), lambda x: F.struct(
            F.concat(x["b"], F.lit(OMITTED), x["e"]).alias("text"), F.lit(True).alias("excerpted"), (F.length(body) - F.length(x["b"]) - F.length(x["e"])).alias("omitted")))

    whole = F.struct(F.coalesce(body, F.lit("")).alias("text"), F.lit(False).alias("excerpted"), F.lit(0).alias("omitted"))
    parts = F.struct(F.substring(body, 1, head_room).alias("head"), F.when(F.lit(tail_room) > 0, F.right(body, F.lit(tail_room))).otherwise("").alias("tail"))
    return F.when(F.length(body) > most, once(parts, joined)).otherwise(whole)


def contains_word(s: Column, word: str) -> Column:
    safe = "".join("\\" + c if c in r".*+?^${}()|[]\/" else c for c in word)
    # a plain search rules out most texts
    return s.contains(word) & s.rlike(f"(^|[^a-z0-9]){safe}([^a-z0-9]|$)")


def clean_body(s: Column) -> Column:
    """Lines trimmed; short junk lines and repeats of short lines go; the rest is joined by blank lines."""
    lines = F.transform(F.split(F.coalesce(s, F.lit("")), "\n"), trimmed)
    junk = lambda x: (F.length(x) < 40) & F.lower(x).rlike("^(advertisement|share|subscribe|sign up|read more|cookie)")
    seen = F.filter(lines, lambda x: (x != "") & ~junk(x))
    firsts = F.filter(F.transform(seen, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                      lambda t: (F.length(t["x"]) >= 80) | (F.array_position(seen, t["x"]) == t["i"] + 1))
    return F.array_join(F.transform(firsts, lambda t: t["x"]), "\n\n")


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def publisher(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "^the ", ""), "[^a-z0-9]", "")


def publisher_key(s: Column) -> Column:
    """A publisher's name without the words that only say what it is."""
    plain = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"(?<![a-z0-9_])(the|podcast|show|magazine|media|daily|weekly)(?![a-z0-9_])", "")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def language_code(s: Column) -> Column:
    code = F.element_at(F.split(F.lower(F.trim(s)), "[-_]"), 1)
    return F.when(~code.isin("", "und", "mul"), code)


def once(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def language_verdict(text: Column, declared: Column) -> Column:
    """Struct (verdict, language): a declared other language wins; else function words of the first 1200 words (of two letters or more) decide."""
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}[\p{L}'’.-]*\p{L}"), F.lit(0)), 1, 1200)
    code = language_code(declared)
    verdict = lambda v, lang: F.struct(F.lit(v).alias("verdict"), lang.cast("string").alias("language"))

    def counts(w: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        count = lambda known: F.regexp_count(line, F.lit(f"(?<= )(?:{'|'.join(known)})(?= )"))
        return F.struct(count(ENGLISH).alias("en"), count(DUTCH).alias("nl"), count(OTHER).alias("other"), F.size(w).alias("n"))

    def decide(c: Column) -> Column:
        en, nl, other = c["en"], c["nl"], c["other"]
        return (F.when((nl >= 5) & (nl >= en * 1.35), verdict("non_english", F.lit("nl")))
                .when((other >= 5) & (other >= en * 1.35), verdict("non_english", F.lit(None)))
                .when((en >= 4) & (en >= F.greatest(nl, other) * 1.25), verdict("english", F.lit("en")))
                .when((code == "en") & (c["n"] >= 8) & (nl < 3) & (other < 3), verdict("english", F.lit("en")))
                .otherwise(verdict("uncertain", code)))

    return F.when(code.isNotNull() & (code != "en"), verdict("non_english", code)).otherwise(once(once(words, counts), decide))


def shouting(s: Column, ratio: float = 0.9, least: int = 24) -> Column:
    letters = F.regexp_replace(F.coalesce(s, F.lit("")), "[^a-zA-Z]", "")
    return (F.length(letters) >= least) & (F.length(F.regexp_replace(letters, "[^A-Z]", "")) >= ratio * F.length(letters))


def human_minutes(m: Column) -> Column:
    whole = F.floor(m + 0.5)
    return (F.when(m.isNull(), F.lit("")).when(whole < 60, F.concat(whole.cast("string"), F.lit(" min")))
            .otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("h"), F.when(whole % 60 > 0, F.concat(F.lit(" "), (whole % 60).cast("string"), F.lit("m"))).otherwise(""))))
