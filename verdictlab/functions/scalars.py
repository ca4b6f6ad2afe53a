"""Scalar expressions over corpus, verdict and catalogue columns. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, functions as F

#: Characters that a byte-wise trim takes off.
BLANKS = " \t\n\r\0\x0b"
COLUMNS = ("comment_id", "content", "author", "author_email", "author_url", "author_ip", "agent", "type")
LINKBACKS = ("trackback", "pingback", "pings")
#: Code-point ranges of scripts that are written without spaces between words. CJK, kana, Hangul, Thai,
#: Lao, Khmer, Myanmar, Tibetan.
SPACELESS = "[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f\u0f00-\u0fff]"


def folded(c: Column) -> Column:
    """Trimmed and lower-cased, null as empty."""
    return F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS)))


def identity_keys(df: DataFrame, split_empty_ip: bool = False) -> DataFrame:
    """``(comment_id, key)``: ``i:<ip>`` always (an empty address is a shared key, unless ``split_empty_ip``),
    ``e:<email>`` and ``u:<url>`` where they aren't empty."""
    ip, email, url = (folded(F.col(c)) for c in ("author_ip", "author_email", "author_url"))
    own = F.concat(F.lit("c:"), F.col("comment_id"))
    first = F.when((ip == "") & F.lit(split_empty_ip), own).otherwise(F.concat(F.lit("i:"), ip))
    keys = F.array_compact(F.array(first, F.when(email != "", F.concat(F.lit("e:"), email)), F.when(url != "", F.concat(F.lit("u:"), url))))
    return df.select("comment_id", F.explode(keys).alias("key"))


def anchor(mode: str) -> Column:
    """The key that names a comment's cluster before any linking: by address (``identity``) or by ``email``."""
    if mode == "identity":
        return F.concat(F.lit("i:"), folded(F.col("author_ip")))
    if mode == "email":
        email = folded(F.col("author_email"))
        return F.when(email == "", F.concat(F.lit("c:"), F.col("comment_id"))).otherwise(F.concat(F.lit("e:"), email))
    raise ValueError(f"unknown cluster mode {mode!r}")


def norm_type(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("comment")).otherwise(c)


def origin_label(c: Column, default: str) -> Column:
    """The historical label; null and empty are ``default``."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def script_class(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).rlike(SPACELESS), "spaceless").otherwise("latin")


def is_spam(c: Column) -> Column:
    return F.coalesce(c == "spam", F.lit(False))


def default_agent(c: Column, agent: str = "Mozilla/5.0 (compatible)") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(agent))


def _pads(key: bytes) -> tuple[str, str]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 (hex) of a string column under a constant key, from two nested built-in digests."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def pseudonym(id_: Column, salt: str) -> Column:
    """First 16 hex digits of HMAC(salt, "id:" + id); the id itself where the salt is empty."""
    if not salt:
        return id_.cast("string")
    return F.substring(hmac_sha256(F.concat(F.lit("id:"), id_.cast("string")), salt.encode()), 1, 16)


def _derive(key: str, label: str, n: int) -> str:
    return hmac.new(key.encode(), label.encode(), hashlib.sha256).hexdigest()[:n]


def derive_salt(fingerprint: str, extra: str = "") -> str:
    """Salt of a corpus: keyed by its fingerprint, a NUL and an extra secret."""
    return _derive(f"{fingerprint}\0{extra}", "verdict-salt", 64)


def salt_check(salt: str) -> str:
    """16 hex digits that tell whether two salts are equal without showing them; empty for an empty salt."""
    return _derive(salt, "salt-check", 16) if salt else ""


def corpus_token(fingerprint: str) -> str:
    return _derive(fingerprint, "corpus-token", 8)


def row_crc(*columns: str) -> Column:
    """CRC-32 of the columns joined by the unit separator; nulls are skipped by the join."""
    return F.crc32(F.encode(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in columns)), "UTF-8"))


def row_hash(*columns: str | Column) -> Column:
    """The first 60 bits of the MD5 of the columns joined by the unit separator, as a long."""
    md5 = F.md5(F.encode(F.concat_ws("\x1f", *((c if isinstance(c, Column) else F.col(c)).cast("string") for c in columns)), "UTF-8"))
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def percent_encode(c: Column) -> Column:
    """RFC 3986 percent-encoding; null is ``\\N``."""
    e = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.coalesce(e, F.lit("\\N"))


def percent_decode(c: Column) -> Column:
    return F.when(c == "\\N", F.lit(None).cast("string")).otherwise(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def reaction(type_: Column) -> Column:
    return F.when(type_.isin(*LINKBACKS), "linkback").otherwise("comment")


def submission(reason: Column) -> Column:
    """How a comment came in: through the decoy field where history says so, else on the genuine path."""
    return F.when(reason == "css", "decoy").otherwise("genuine")


def anonymise(df: DataFrame) -> DataFrame:
    """The envelope replaced by synthetic values that depend on the id alone; ``is_ham`` rows lose text and URL too."""
    n = F.col("comment_id")
    ham = F.col("is_ham")
    return df.select(
        "comment_id",
        F.when(ham, F.concat(F.lit("Synthetic text "), n)).otherwise(F.col("content")).alias("content"),
        F.concat(F.lit("Author "), n).alias("author"),
        F.concat(F.lit("author"), n, F.lit("@example.com")).alias("author_email"),
        F.when(ham, F.lit("https://example.com/")).otherwise(F.col("author_url")).alias("author_url"),
        F.concat(F.when(n % 2 == 0, "192.0.2.").otherwise("198.51.100."), (n % 254 + 1)).alias("author_ip"),
        "agent", "type",
    )


def direction(new_status: Column) -> Column:
    return F.when(is_spam(new_status), "=> spam").otherwise("=> not spam")


def shard_of(root: Column, n: int) -> Column:
    return (F.crc32(F.encode(root, "UTF-8")) % n).cast("int")


def mod_shard(id_: Column, n: int) -> Column:
    return F.pmod(id_, F.lit(n)).cast("int")


def rule_hits(df: DataFrame) -> DataFrame:
    """``(id, rule)``, one row per slug of the reason; rows without a reason give one null rule."""
    return df.select("id", F.explode_outer(F.split("reason", ",")).alias("rule"))


def b64(c: Column) -> Column:
    """Base64 of a text's UTF-8 bytes in one line (a line of fields can't hold breaks); null as empty."""
    return F.regexp_replace(F.base64(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), "[\r\n]", "")


def unb64(c: Column) -> Column:
    """The text back; null, and what isn't base64, is empty."""
    return F.coalesce(F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8"), F.lit(""))


def hard_fp(*columns: str) -> Column:
    """SHA-256 over the conditions that must be equal for two passes to be comparable."""
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)


def options_fp(json: Column) -> Column:
    return F.substring(F.sha2(json, 256), 1, 16)


def version_key(c: Column) -> Column:
    """``struct(major, minor, patch, stable, kind, number, text)``, which compares as versions do.

    A directory, ``prepare-`` and a leading v are taken off. A prerelease stands below its stable version;
    prereleases of one core compare by name, then by number. Null where no version is found.
    """
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^.*/", ""), "^prepare-", ""), "^[vV]", "")
    shape = r"^(\d+)\.(\d+)(?:\.(\d+))?(?:-([A-Za-z]+)?\.?(\d+)?(.*))?$"
    part = lambda i: F.regexp_extract(s, shape, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0))
    key = F.struct(
        number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"),
        (~F.contains(s, F.lit("-"))).alias("stable"), part(4).alias("kind"), number(5).alias("number"), s.alias("text"),
    )
    return F.when(s.rlike(shape), key)
