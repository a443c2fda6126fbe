"""Evidence detectors: each maps a string to findings, as Column expressions.

Strings are printable ASCII (functions.strings), so regular expressions mean the
same here as elsewhere. A detector is an entry of DETECTORS; findings of all are
one array expression per string, and counts per document are conditional sums,
so a scan is one pass with map-side aggregation.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import let

# Fixed values of the rules: word lists, patterns, thresholds.
CREDENTIAL_WORDS = "password passwd pwd pass secret credential passphrase pswd psw userpass loginpass psk".split()
METADATA_WORDS = "length len size hash algorithm algo policy timeout".split()
NULL_WORDS = ["null", "none", "nil", "undefined", "(null)"]
AUTH_WORDS = "login user username account credential auth senha password passwd pwd default".split()
DEFAULT_PASSWORDS = (
    "admin password 1234 12345 123456 admin123 root toor pass test 1234567890 guest default support supervisor service system ubnt huawei "
    "zte521 telnet enable"
).split()
WEAK_WORDS = (
    "admin root guest test default user support supervisor service system ubnt huawei zte521 password 1234 12345 123456 admin123 toor pass "
    "enable telnet"
).split()
NETWORK_WORDS = (
    "ip ipaddr host hostname server gateway gw dns ntp route addr address proxy remote peer connect bind listen"
).split()
DEBUG_WORDS = "debug guest test".split()
KEY_VALUE = r"\b([A-Za-z][A-Za-z0-9_-]{0,40})\s*[=:]\s*([^\s&;]+)"
PAIR = r"\b([A-Za-z0-9]{1,20}):([A-Za-z0-9]{1,20})\b"
URL = r"(?i)https?://[^\s\"'<>]+"
IPV4 = r"(?<![-_A-Za-z0-9.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![-_A-Za-z0-9]|\.[-_A-Za-z0-9])"
AFTER_VERSION = r"(?<!(?i:\bv|\bversion|\bLinux-)\s{0,1024})"
TOKEN = r"(?<![A-Za-z0-9+/])(?:[0-9a-fA-F]{32,}|[A-Za-z0-9+/]{40,}={0,2})(?![A-Za-z0-9+/=])"
TOKEN_ENTROPY, TOKEN_RUN, TOKEN_SHOWN = 4.3, 5, 12
LIBRARIES = {
    "libssl": (r"(?i)OpenSSL[\s/]+([\d]+\.[\d]+\.[\d]+[a-z]?)", (1, 1, 1)),
    "busybox": (r"(?i)BusyBox[\s_]*v?([\d]+\.[\d]+\.[\d]+)", (1, 33, 0)),
    "dropbear": (r"(?i)Dropbear\s+(?:SSH\s+)?v?(\d{4}\.\d+|0\.\d{2}(?:\.\d+)?)", (2022, 82)),
}
FILESYSTEM = r"(?i)squashfs|cramfs|jffs2|romfs|ext[234]|ubifs|yaffs"
COMPRESSION = r"(?i)\blzma\b|\bgzip\b|\bxz\b|\bzstd\b|\blzo\b|\bbzip2\b"
CRYPTO = r"(?i)\bAES\b|\bDES\b|\bRSA\b|certificate|private\skey"
ENCRYPTED = r"(?i)encrypt|\bAES\b|cipher"
#: Networks that aren't global, as (first, last) addresses; 192.0.0.9 and .10 are.
NOT_GLOBAL = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]


def address_number(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _all(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def _set(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words_in(s: Column) -> Column:
    return _all(F.lower(s), "[a-z0-9]+")


def has_any(s: Column, parts: list[str]) -> Column:
    """Whether some of parts, in lower case, occur anywhere in any case. A search for each is many
    times as fast as a regular expression of all, which tries each at each place.
    """
    return let(F.lower(s), lambda x: reduce(or_, [F.contains(x, F.lit(p)) for p in parts]))


def may_have_auth_word(s: Column) -> Column:
    """A cheap test that every string with a trigger word passes, before its words are split."""
    return has_any(s, "login user account credential auth senha pass pwd default".split())


def quoted(s: Column) -> Column:
    """A string as a quoted literal: double quotes only around single ones."""
    escaped = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def _hits(contexts: Column, confidence: str) -> Column:
    """array<struct<context, confidence>> of an array of contexts."""
    return F.transform(contexts, lambda c: F.struct(c.alias("context"), F.lit(confidence).alias("confidence")))


def _one(condition: Column, context: Column, confidence: str) -> Column:
    empty = F.array().cast("array<struct<context:string,confidence:string>>")
    return F.when(condition, F.array(F.struct(context.alias("context"), F.lit(confidence).alias("confidence")))).otherwise(empty)


def is_credential_key(key: Column) -> Column:
    parts = F.split(F.lower(F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])", "_")), "[_-]")
    return F.arrays_overlap(parts, _set(CREDENTIAL_WORDS)) & ~F.arrays_overlap(parts, _set(METADATA_WORDS))


def is_placeholder(value: Column) -> Column:
    """Format specifiers, variables, templates and null words."""
    return (
        value.startswith("%")
        | value.rlike(r"^\$\{?\w+\}?$")
        | value.rlike(r"^\{\{?\w+\}?\}$|^<\w+>$")
        | F.lower(F.trim(value, F.lit("()"))).isin(*NULL_WORDS)
    )


def hardcoded_passwords(s: Column) -> Column:
    # A match is read again by itself, which gives the same key and value.
    key, value = (lambda m, i=i: F.regexp_extract(m, KEY_VALUE, i) for i in (1, 2))
    pairs = F.filter(_all(s, KEY_VALUE), lambda m: is_credential_key(key(m)) & let(value(m), lambda v: ~is_placeholder(v)))
    plain = _set([w for w in DEFAULT_PASSWORDS if w not in AUTH_WORDS])
    named = F.filter(_all(s, "[A-Za-z0-9]+"), lambda w: F.array_contains(plain, F.lower(w)))
    empty = F.array().cast("array<struct<context:string,confidence:string>>")
    weak = may_have_auth_word(s) & (F.size(named) > 0) & F.arrays_overlap(words_in(s), _set(AUTH_WORDS))
    high = lambda kept: F.array(F.struct(F.concat(F.lit("key=value assignment: "), quoted(F.get(kept, 0))).alias("context"), F.lit("high").alias("confidence")))
    medium = F.array(F.struct(F.concat(F.lit("default password token: "), quoted(F.get(named, 0))).alias("context"), F.lit("medium").alias("confidence")))
    # Every credential key has one of these; the pairs of other strings aren't looked at.
    keyed = (F.contains(s, F.lit("=")) | F.contains(s, F.lit(":"))) & has_any(s, "pass pwd secret credential psw psk".split())
    none = F.array().cast("array<string>")
    return let(F.when(keyed, pairs).otherwise(none), lambda kept: F.when(F.size(kept) > 0, high(kept)).when(weak, medium).otherwise(empty))


def credential_pairs(s: Column) -> Column:
    found = F.arrays_zip(_all(s, PAIR, 1).alias("a"), _all(s, PAIR, 2).alias("b"), _all(s, PAIR, 0).alias("m"))
    weak = _set(WEAK_WORDS)
    kept = F.filter(found, lambda x: F.array_contains(weak, F.lower(x["a"])) & F.array_contains(weak, F.lower(x["b"])))
    return _one(F.contains(s, F.lit(":")) & (F.size(kept) > 0), F.concat(F.lit("weak user:pass pair: "), quoted(F.get(kept, 0)["m"])), "high")


def contextual_addresses(s: Column) -> Column:
    """array<string>: valid IPv4 outside of URLs, not after a version word, in a
    string with a network word or a URL, or followed by a port.
    """
    # The URL alternative goes first and takes the addresses inside of URLs with it.
    ip = f"{AFTER_VERSION}{IPV4}"
    context = F.arrays_overlap(words_in(s), _set(NETWORK_WORDS)) | F.lower(s).rlike("https?://")
    either = lambda tail: F.filter(_all(s, f"{URL}|(?-i:{ip}{tail})"), lambda m: m.rlike("^[0-9]"))
    found = F.when(context, either("")).otherwise(either(r"(?=:\d)"))

    def valid(a: Column) -> Column:
        octets = F.transform(F.split(a, r"\."), lambda o: o.cast("int"))
        return F.forall(octets, lambda o: o <= 255) & ~F.get(octets, 0).isin(0, 127, 255)

    shaped = s.rlike(r"\d\.\d{1,3}\.\d{1,3}\.\d")
    return F.when(shaped, F.filter(found, valid)).otherwise(F.array().cast("array<string>"))


def number_of(address: Column) -> Column:
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda t, o: t * 256 + o.cast("long"))


def is_public(address: Column) -> Column:
    inside = lambda n: reduce(or_, [n.between(address_number(first), address_number(last)) for first, last in NOT_GLOBAL])
    return let(number_of(address), lambda n: ~inside(n))


def plain_address(address: Column) -> Column:
    """Octets without leading zeros."""
    return F.array_join(F.transform(F.split(address, r"\."), lambda o: o.cast("int").cast("string")), ".")


def public_ips(s: Column, addresses: Column | None = None) -> Column:
    """addresses: contextual_addresses of s, where they are known."""
    found = F.filter(contextual_addresses(s) if addresses is None else addresses, is_public)
    return _hits(F.transform(found, lambda a: F.concat(F.lit("public (global) IPv4 address: "), plain_address(a))), "high")


def non_public_ips(s: Column, addresses: Column | None = None) -> Column:
    found = F.filter(contextual_addresses(s) if addresses is None else addresses, lambda a: ~is_public(a))
    return _hits(F.transform(found, lambda a: F.concat(F.lit("non-public IPv4 address: "), plain_address(a))), "low")


def telnetd(s: Column) -> Column:
    return _one(F.contains(s, F.lit("telnetd")), F.lit("'telnetd' substring found"), "high")


def debug_account(s: Column) -> Column:
    words = words_in(s)
    names = F.filter(words, lambda w: F.array_contains(_set(DEBUG_WORDS), w))
    return _one(
        has_any(s, DEBUG_WORDS) & may_have_auth_word(s) & (F.size(names) > 0) & F.arrays_overlap(words, _set(AUTH_WORDS)),
        F.concat(F.lit("debug/guest/test keyword: "), quoted(F.get(names, 0))), "low"
    )


def version_numbers(version: Column) -> Column:
    """array<long>: the leading digits of the parts between dots, dashes and underscores."""
    digits = F.transform(F.split(version, r"[.\-_]"), lambda p: F.regexp_extract(p, r"^(\d+)", 1))
    return F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("long"))


def outdated(library: str) -> Callable[[Column], Column]:
    pattern, least = LIBRARIES[library]
    name = re.match(r"\(\?i\)(\w+?)(?=\[|\\)", pattern)[1].lower()

    def build(s: Column) -> Column:
        version = F.regexp_extract(s, pattern, 1)
        threshold = F.array(*[F.lit(n).cast("long") for n in least])
        shown = "(" + ", ".join(map(str, least)) + ")"
        return _one(
            F.contains(F.lower(s), F.lit(name)) & (version != "") & (version_numbers(version) < threshold),
            F.concat(F.lit(f"{library} version "), version, F.lit(f" below threshold {shown}")),
            "medium",
        )

    return build


def urls(s: Column) -> Column:
    found = F.when(F.contains(s, F.lit("://")), _all(s, URL)).otherwise(F.array().cast("array<string>"))
    return _hits(F.transform(found, lambda u: F.concat(F.lit("URL: "), u)), "low")


def has_ascending_run(text: Column, n: int) -> Column:
    """Whether n characters in a row have consecutive codes."""
    chars = F.split(text, "")
    steps = F.aggregate(
        F.slice(chars, 2, F.greatest(F.length(text) - 1, F.lit(0))),
        F.struct(F.ascii(text).alias("last"), F.lit(1).alias("run"), F.lit(1).alias("most")),
        lambda t, c: F.struct(
            F.ascii(c).alias("last"),
            F.when(F.ascii(c) == t["last"] + 1, t["run"] + 1).otherwise(1).alias("run"),
            F.greatest(t["most"], F.when(F.ascii(c) == t["last"] + 1, t["run"] + 1).otherwise(1)).alias("most"),
        ),
    )
    return steps["most"] >= n


def ascending_runs(alphabet: str, n: int) -> list[str]:
    """All runs of n consecutive codes within an alphabet."""
    runs = ["".join(chr(ord(c) + i) for i in range(n)) for c in sorted(alphabet)]
    return [r for r in runs if set(r) <= set(alphabet)]


def ascending_pattern(alphabet: str, n: int) -> str:
    """A regular expression of ascending_runs."""
    return "|".join(map(re.escape, ascending_runs(alphabet, n)))


def text_entropy(text: Column) -> Column:
    """Shannon entropy of the characters, base 2."""
    size = F.length(text).cast("double")
    without = lambda c: F.length(F.replace(text, c, F.lit("")))
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - without(c)) / size)
    return -F.aggregate(shares, F.lit(0.0), lambda t, p: t + p * F.log2(p))


def api_tokens(s: Column) -> Column:
    runs = ascending_runs(string.digits + string.ascii_letters + "+/=", TOKEN_RUN)

    def good(t: Column) -> Column:
        mixed = t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9]")
        run = reduce(or_, [F.contains(t, F.lit(r)) for r in runs])
        return ~run & (t.rlike("^[0-9a-fA-F]{32,}$") | (mixed & (text_entropy(t) >= TOKEN_ENTROPY)))

    found = F.when((F.length(s) >= 32) & s.rlike("[A-Za-z0-9+/]{32}"), F.filter(_all(s, TOKEN), good)).otherwise(F.array().cast("array<string>"))
    return _hits(F.transform(found, lambda t: F.concat(F.lit("long token: "), F.substring(t, 1, TOKEN_SHOWN), F.lit("…"))), "low")


def crypto_signatures(d: Column) -> Column:
    m = F.regexp_extract(d, CRYPTO, 0)
    return _one(m != "", F.concat(F.lit("cryptographic construct: "), quoted(m)), "medium")


def encrypted_sections(d: Column) -> Column:
    m = F.regexp_extract(d, ENCRYPTED, 0)
    return _one((m != "") & ~F.contains(F.lower(d), F.lit("s-box")), F.concat(F.lit("encryption indicator: "), quoted(m)), "medium")


class Detector(NamedTuple):
    name: str
    version: str
    kind: str
    build: Callable[[Column], Column]
    #: "count" or "flag" of the document, or None for detectors of signature lines.
    reduces: str | None
    column: str | None


#: In the order of the scan.
DETECTORS = [
    Detector("hardcoded_passwords", "2.0", "credential_candidate", hardcoded_passwords, "count", "count_hardcoded_passwords"),
    Detector("credential_pairs", "1.0", "credential_pair", credential_pairs, "count", "count_credential_pairs"),
    Detector("non_public_ips", "2.0", "non_public_ip", non_public_ips, "count", "count_non_public_ips"),
    Detector("public_ips", "2.0", "public_ip", public_ips, "count", "count_public_ips"),
    Detector("telnetd", "1.0", "exposed_service", telnetd, "flag", "has_telnetd"),
    Detector("debug_account", "2.0", "debug_account", debug_account, "flag", "has_debug_account"),
    Detector("outdated_libssl", "1.0", "outdated_library", outdated("libssl"), "flag", "has_outdated_libssl"),
    Detector("outdated_busybox", "1.0", "outdated_library", outdated("busybox"), "flag", "has_outdated_busybox"),
    Detector("outdated_dropbear", "2.0", "outdated_library", outdated("dropbear"), "flag", "has_outdated_dropbear"),
    Detector("urls", "1.0", "url", urls, "count", "count_urls"),
    Detector("api_tokens", "2.0", "api_token_candidate", api_tokens, "count", "count_api_tokens"),
    Detector("crypto_signatures", "1.0", "crypto_signature", crypto_signatures, None, None),
    Detector("encrypted_sections", "2.0", "encrypted_section", encrypted_sections, None, None),
]
SCANNED = [d for d in DETECTORS if d.reduces]


#: The fields of a finding.
FIELDS = ["type", "source", "context", "confidence", "detector", "detector_version"]
OF_ADDRESSES = ["public_ips", "non_public_ips"]


def findings_of(s: Column, detectors: list[Detector] = SCANNED, fields: list[str] = FIELDS, addresses: Column | None = None) -> Column:
    """array<struct of fields>. addresses: contextual_addresses of s, where they are known."""

    def told(d: Detector, h: Column | None) -> Column:
        known = {"type": F.lit(d.kind), "source": s, "detector": F.lit(d.name), "detector_version": F.lit(d.version)}
        return F.struct(*[(known[f] if f in known else h[f]).alias(f) for f in fields])

    def found(d: Detector) -> Column:
        hits = d.build(s, addresses) if d.name in OF_ADDRESSES else d.build(s)
        if {"context", "confidence"} & set(fields):
            return F.transform(hits, lambda h: told(d, h))
        return F.array_repeat(told(d, None), F.size(hits))

    return F.concat(*[found(d) for d in detectors])


def find(strings: DataFrame, keys: list[str], text: str = "s", detectors: list[Detector] = SCANNED, fields: list[str] = FIELDS) -> DataFrame:
    """One row for each finding: keys and the fields of a finding. The addresses of a string
    are found once for both detectors of addresses.
    """
    if not set(OF_ADDRESSES) <= {d.name for d in detectors}:
        return strings.select(*keys, F.inline(findings_of(F.col(text), detectors, fields)))
    step = strings.select(*keys, F.col(text).alias("__s"), contextual_addresses(F.col(text)).alias("__ips"))
    return step.select(*keys, F.inline(findings_of(F.col("__s"), detectors, fields, F.col("__ips"))))


def reduce_findings(documents: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """The counts and flags of every document, zero and false where nothing was
    found; findings of other detectors are left out.
    """
    sums = []
    for d in SCANNED:
        n = F.count_if(F.col("detector") == d.name)
        sums.append((n if d.reduces == "count" else n > 0).alias(d.column))
    reduced = findings.groupBy(key).agg(*sums)
    empty = {d.column: F.lit(0) if d.reduces == "count" else F.lit(False) for d in SCANNED}
    return documents.select(key).distinct().join(reduced, key, "left").select(key, *[F.coalesce(c, e).alias(c) for c, e in empty.items()])


def scan_counts(strings: DataFrame, documents: DataFrame, key: str, text: str = "s") -> DataFrame:
    """As reduce_findings of find, without a row for each finding in between. The
    addresses of a string are found once for both detectors of addresses.
    """
    step = strings.select(key, F.col(text).alias("__s"), contextual_addresses(F.col(text)).alias("__ips"))
    public = F.size(F.filter("__ips", is_public))
    sizes = {"public_ips": public, "non_public_ips": F.size("__ips") - public}
    sized = step.select(key, *[sizes.get(d.name, F.size(d.build(F.col("__s")))).alias(d.column) for d in SCANNED])
    sums = [(F.sum(d.column).cast("long") if d.reduces == "count" else F.max(d.column) > 0).alias(d.column) for d in SCANNED]
    reduced = sized.groupBy(key).agg(*sums)
    empty = {d.column: F.lit(0).cast("long") if d.reduces == "count" else F.lit(False) for d in SCANNED}
    return documents.select(key).distinct().join(reduced, key, "left").select(key, *[F.coalesce(c, e).alias(c) for c, e in empty.items()])


def third_party(strings: DataFrame, key: str, banner: str = "DD-WRT") -> DataFrame:
    return strings.groupBy(key).agg(F.bool_or(F.contains("s", F.lit(banner))).alias("third_party"))


# Signature lines -----------------------------------------------------------


def signature_text(line: Column) -> Column:
    """The description of a scan's output line: a number, a field, the rest; else null."""
    text = F.regexp_extract(line, r"^\s*(\d+)\s+\S+\s+(.*)$", 2)
    return F.when(line.rlike(r"^\s*\d+\s+\S+\s+.*$"), text)


def structural_features(lines: DataFrame, key: str) -> DataFrame:
    """(key, n_filesystems, fs_type, compression_type, n_crypto_signatures,
    has_encrypted_sections) of (key, pos, description).

    fs_type: the most frequent, the first seen of equals. compression_type: the first.
    """
    marked = lines.select(
        key,
        "pos",
        F.lower(F.regexp_extract("description", FILESYSTEM, 0)).alias("fs"),
        F.lower(F.regexp_extract("description", COMPRESSION, 0)).alias("packed"),
        F.size(crypto_signatures(F.col("description"))).alias("crypto"),
        F.size(encrypted_sections(F.col("description"))).alias("encrypted"),
    )
    kinds = marked.where("fs <> ''").groupBy(key, "fs").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("seen"))
    modal = kinds.groupBy(key).agg(F.max_by("fs", F.struct(F.col("n"), -F.col("seen"))).alias("fs_type"))
    rest = marked.groupBy(key).agg(
        F.count_if(F.col("fs") != "").alias("n_filesystems"),
        F.min_by(F.when(F.col("packed") != "", F.col("packed")), F.when(F.col("packed") != "", F.col("pos"))).alias("compression_type"),
        F.sum("crypto").alias("n_crypto_signatures"),
        (F.sum("encrypted") > 0).alias("has_encrypted_sections"),
    )
    return rest.join(modal, key, "left")


def effective_unpack_status(status: Column, fs_type: Column, none: str, failure: str) -> Column:
    """No filesystem unpacked (none) though one was detected is a failure."""
    return F.when((status == none) & fs_type.isNotNull(), F.lit(failure)).otherwise(status)
