"""Feature extraction and normalisation as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark licence files, files that come from elsewhere, third-party and source directories.
LICENSE_WORDS = (
    "copying", "license", "licence", "licensing", "gnu", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "agpl",
    "agplv2", "agplv3", "apache", "apl", "bsd", "cddl", "mit", "mozilla", "mpl", "mplv2", "eclipse", "epl", "qpl", "isc", "readme",
)
INDEPENDENT_WORDS = ("changelog", "autogen", "configure", "thanks", "release-notes", "releasenotes", "changes", "whatsnew")
THIRD_PARTY_WORDS = ("3rdparty", "3rd.party", "thirdparty", "third.party", "external", "externals")
SOURCE_WORDS = ("src", "source")
# Source file suffixes and the kind of file they mean; case matters.
FILE_KINDS = {
    "c": "C", "h": "H", "cc": "CPP", "cpp": "CPP", "c++": "CPP", "cxx": "CPP", "C": "CPP",
    "hh": "HPP", "hxx": "HPP", "hpp": "HPP", "H": "HPP",
}
# Package prefixes of framework classes, primitive types, methods every object has.
FRAMEWORK_PREFIXES = ("java", "javax", "org.w3c", "org.xml", "org.omg", "org.ietf", "org.apache", "org.json", "android", "junit")
PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double", "void")
# The blank before getClass belongs to the value: no method has that name, so getClass counts as the application's own.
OBJECT_METHODS = ("clone", "equals", "finalize", " getClass", "hashCode", "notify", "notifyAll", "toString", "wait", "<init>", "<clinit>")
# Literals of C source (quoted in ones, raw ones with their mark, quoted in twos), lines that hold none, and the head of a
# function's definition: what comes before it, return type, scope, name, parameters, attributes, brace; and words that are no names.
LITERALS = r"""'[^'\\]*(?:\\.[^'\\]*)*'|R"([^"(]*)\((.*?)\)\1"|"([^"\\]*(?:\\.[^"\\]*)*)\""""
INCLUDE_LINE, COMMENT_LINE = r'#\s*include\s*(?:<[^>]*>|"[^"]*")', r"/\*.*?\*/|^\s*\*\s.*$"
FUNCTION_HEAD = r"(?:^|;|\};?|public:|private:)\s*(\w[\w\s,<>\[\].&:*]*)\s+(?:\*|[*|\w][\w<>*\[\]&]*::)?(\w+)\s*\(([\w\s,<>\[\].=&':/*]*)\)\s*[\w\s]*\{"
NO_FUNCTIONS = ("if", "while", "do", "for", "switch")
# What parts a tag, a group of digits, what may stand between groups, and what bounds a version in a banner.
TAG_PARTS, DIGIT_GROUP, BETWEEN, BEFORE, AFTER = r"[,.\-_/|\\]", r"(\d+[a-zA-Z]*)", r"[.\-_]", r"(^|v|[^,:.\w])", r"($|[^,:.\w])"
# Signs of unfinished releases, names of unwanted repositories, words in hosts of open source.
UNSTABLE = (r"\drc", r"rc\d", "alpha", "beta", "preview", "unstable")
UNWANTED_REPOS = ("kernel", "qemu", "kvm", "xen", "u-boot", "uboot")
OSS_HOSTS = ("github.", "bitbucket.", "gitlab.")
#: Licence texts to abbreviations; our own rules, the first line's words decide.
LICENSE_RULES = (
    ("lesser general public license", "LGPL"), ("affero general public license", "AGPL"), ("general public license", "GPL"),
    ("apache license", "Apache"), ("mit license", "MIT"), ("mozilla public license", "MPL"), ("bsd license", "BSD"), ("creative commons|cc by", "CC"),
)


def word_pattern(words: Sequence[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_license_file(path: Column) -> Column:
    return basename(path).rlike(word_pattern(LICENSE_WORDS))


def is_independent_file(path: Column) -> Column:
    return basename(path).rlike(word_pattern(INDEPENDENT_WORDS))


def is_third_party(path: Column) -> Column:
    return dirname(path).rlike(word_pattern(THIRD_PARTY_WORDS))


def file_kind(path: Column) -> Column:
    """C, H, CPP or HPP by suffix; null for other files."""
    suffix = F.regexp_extract(path, r"\.([^./]+)$", 1)
    kinds = F.create_map(*[F.lit(x) for kv in FILE_KINDS.items() for x in kv])
    return kinds[suffix]


def is_ascii(s: Column) -> Column:
    """Every character from code point 21 to 127."""
    return s.rlike(r"^[\x15-\x7F]*\z")  # $ would let a line end at the end pass


def is_feature_string(s: Column, min_length: int = 3) -> Column:
    return is_ascii(s) & (F.length(s) >= min_length)


def inflated(s: Column) -> Column:
    """A constant's lines and, if there are several, the whole with line ends escaped."""
    whole = F.regexp_replace(F.replace(s, F.lit("\r"), F.lit("")), "\n$", "")
    lines = F.split(whole, "\n")
    return F.when(F.size(lines) > 1, F.concat(lines, F.array(F.replace(whole, F.lit("\n"), F.lit("\\n"))))).otherwise(lines)


def function_parts(bare: Column, full: Column) -> tuple[Column, Column]:
    """(name with parameters, last name) of a demangled native function; null where it makes no feature.

    Functions of ``std`` make none, nor do scoped names without parameters. Scopes inside parameters go, but for ``std::``.
    """
    params = F.substring(full, F.length(bare) + 1, F.length(full))
    clean = F.regexp_replace(params, r"(?!std::)\b\w+::", "")
    usable = ~bare.startswith("std::") & full.startswith(bare) & ((F.length(params) > 0) | ~bare.contains("::"))
    last = F.element_at(F.split(bare, "::"), -1)
    return F.when(usable, F.concat(bare, clean)), F.when(usable, last)


def string_literals(text: Column) -> Column:
    """Double-quoted and raw literals of C source, line by line; lines with includes and closed comments are passed over, and so are empty literals."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(INCLUDE_LINE) & ~x.rlike(COMMENT_LINE))
    found = lambda x, group: F.regexp_extract_all(x, F.lit(LITERALS), F.lit(group))
    each = F.transform(lines, lambda x: F.zip_with(found(x, 2), found(x, 3), lambda raw, plain: F.concat(raw, plain)))  # one of them is empty
    return F.filter(F.flatten(each), lambda x: x != "")


def function_names(text: Column, exported_only: bool = True) -> Column:
    """Names of functions defined in C source; with ``exported_only`` not those whose return type says static.

    A definition begins with the text, or after a statement, a block or a visibility mark, on whatever line.
    """
    names, kinds = (F.regexp_extract_all(text, F.lit(FUNCTION_HEAD), F.lit(k)) for k in (2, 1))
    fit = F.filter(F.arrays_zip(names.alias("n"), kinds.alias("k")), lambda p: ~p["n"].isin(*NO_FUNCTIONS) & (F.lit(not exported_only) | ~p["k"].contains("static")))
    return F.transform(fit, lambda p: p["n"])


def centroid_text(plain: Sequence[Column], invoking: Sequence[Column], prefix: str = "centroids") -> Column:
    """A centroid as text: its places with four decimals and its weight, and the same with invocations weighed in."""
    return F.concat(F.lit(prefix), *[F.format_string("(%.4f,%.4f,%.4f,%d)", *(c.cast("double") for c in part[:3]), part[3].cast("long")) for part in (plain, invoking)])


def parsed_record(record: Column, flags: int) -> dict[str, Column]:
    """Fields of a parser's record ``type:[group:][export:][four places:]feature``; ``flags``: 1 group, 2 export, 4 places."""
    names = ["type"] + ["grp"] * bool(flags & 1) + ["export_type"] * bool(flags & 2) + ["start_row", "start_col", "end_row", "end_col"] * bool(flags & 4)
    parts = F.split(record, ":", len(names) + 1)
    out = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}
    out = {n: c if n == "type" else c.cast("int") for n, c in out.items()}
    feature = F.get(parts, F.lit(len(names)))
    out["feature"] = F.when(out["type"] == "s", F.substring(feature, 2, F.length(feature) - 2)).otherwise(feature)
    return out


def simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def no_package_signature(cls: Column, method: Column, params: Column, returns: Column, framework: Column) -> Column:
    """A method's signature with simple names for all but referenced framework classes."""
    short = lambda t: F.when(F.array_contains(framework, t), t).otherwise(simple_name(t))
    return F.concat(short(returns), F.lit(" "), simple_name(cls), F.lit("."), method, F.lit("("), F.concat_ws(",", F.transform(params, short)), F.lit(")"))


def normal_signature(method: Column, params: Column, returns: Column, framework: Column) -> Column:
    """A method's signature that survives renaming: only primitive and framework types and inherited names stay."""
    keep = lambda t: F.when(t.isin(*PRIMITIVES) | F.array_contains(framework, t), t).otherwise("APP_CLASS")
    name = F.when(method.isin(*OBJECT_METHODS), method).otherwise("APP_METHOD")
    return F.concat(F.lit("norm:"), keep(returns), F.lit(" "), name, F.lit("("), F.concat_ws(",", F.transform(params, keep)), F.lit(")"))


def class_string(signatures: Column) -> Column:
    """Sorted signatures, each followed by a comma."""
    return F.concat(F.array_join(F.array_sort(signatures), ","), F.lit(","))


def is_framework(name: Column) -> Column:
    out = F.lit(False)
    for p in FRAMEWORK_PREFIXES:
        out = out | name.startswith(p)
    return out


def license_family(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("lgpl"), "lgpl").when(low.contains("gpl"), "gpl").otherwise("nongpl")


def license_of_line(line: Column) -> Column:
    """The abbreviation of the first rule that a line of licence text meets, else null."""
    low = F.lower(line)
    out = None
    for pattern, name in LICENSE_RULES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#\s]+)", 1))


def is_oss_host(name: Column) -> Column:
    out = F.lit(False)
    for p in OSS_HOSTS:
        out = out | name.contains(p)
    return out


def version_string(tag: Column) -> Column:
    """The groups of digits, each with the letters after it, joined by dots."""
    return F.array_join(F.regexp_extract_all(tag, F.lit(DIGIT_GROUP), F.lit(1)), ".")


def version_pattern(tag: Column) -> Column:
    """A pattern that finds a tag's version in a banner.

    It is made of the digit groups of the first run of parts that hold digits, with any of ``. - _`` between
    them, and bounds that are no version's.
    """
    parts = F.split(tag, TAG_PARTS)
    state = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("got")),
        lambda a, p: F.when((a["at"] < 2) & p.rlike(r"\d"), F.struct(F.lit(1).alias("at"), F.concat(a["got"], F.regexp_extract_all(p, F.lit(DIGIT_GROUP), F.lit(1))).alias("got")))
        .when(a["at"] == 1, F.struct(F.lit(2).alias("at"), a["got"].alias("got"))).otherwise(a),
    )
    return F.concat(F.lit(BEFORE), F.array_join(state["got"], BETWEEN), F.lit(AFTER))


def is_version_feature(tag: Column, feature: Column) -> Column:
    """Whether a feature's text holds the version of a tag with two digit groups at least."""
    return (F.size(F.regexp_extract_all(tag, F.lit(r"(\d+)"), F.lit(1))) > 1) & F.coalesce(F.regexp_like(feature, version_pattern(tag)), F.lit(False))


def is_unstable(tag: Column) -> Column:
    return F.lower(tag).rlike("|".join(UNSTABLE))


def name_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; null if both are empty."""
    return F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def cut_to_scale(x: Column, scale: Column) -> Column:
    """Toward zero to a power of ten."""
    factor = F.pow(F.lit(10.0), -scale)
    return F.signum(x) * F.floor(F.abs(x) * factor) / factor


def cut_to_digits(x: Column, k: int = 1) -> Column:
    """Toward zero to ``k`` digits."""
    return F.when(x == 0, F.lit(0.0)).otherwise(cut_to_scale(x, F.floor(F.log10(F.abs(x))) - (k - 1)))


def split_name_version(stem: Column) -> tuple[Column, Column]:
    """The parts before and after the last hyphen; without one, the whole and null."""
    has = stem.contains("-")
    return F.when(has, F.regexp_extract(stem, "^(.*)-([^-]*)$", 1)).otherwise(stem), F.when(has, F.regexp_extract(stem, "^(.*)-([^-]*)$", 2))
