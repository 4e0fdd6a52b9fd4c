"""Request headers: parsing, checking, overlaying, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers that the client sets itself, longest value, words of sensitive names, defaults.
FORBIDDEN = ("host", "content-length", "transfer-encoding", "connection")
MAX_VALUE_BYTES = 8192
SENSITIVE = ("authorization", "token", "key", "secret", "password", "credential", "api-key")
DEFAULTS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Accept": "*/*",
    "Accept-Encoding": "gzip, deflate, br",
}
# What is wrong with a header and what helps, by kind; %1 is the header's name, %2 the value's bytes, %3 the limit.
PROBLEM_TEXTS = {
    "empty_name": "头部验证失败 [%1]: 头部名称不能为空",
    "bad_name": "头部验证失败 [%1]: 头部名称包含非法字符 (仅允许字母、数字和连字符) (建议: 使用字母、数字和连字符 (如 'User-Agent', 'X-Custom-Header'))",
    "value_too_long": "头部验证失败 [%1]: 头部值过长: %2 字节 (最大 %3) (建议: 将值缩短至 %3 字节以内)",
    "bad_value": "头部验证失败 [%1]: 头部值包含非法字符 (仅允许可打印ASCII字符) (建议: 移除控制字符和非ASCII字符)",
    "forbidden_name": "头部验证失败 [%1]: 此头部由HTTP客户端自动管理,不允许自定义 (建议: 移除 '%1' 头部配置)",
}


def parsed(line: Column) -> Column:
    """``Name: Value`` as a struct of name, value and error; the first colon divides."""
    parts = F.split(line, ":", 2)
    name, value = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    error = F.when(F.size(parts) < 2, "missing_colon").when(name == "", "empty_name")
    return F.struct(
        F.when(error.isNull(), name).alias("name"), F.when(error.isNull(), value).alias("value"), error.alias("error")
    )


def canonical(name: Column) -> Column:
    """Header names as clients write them: each part between hyphens capitalised."""
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "-")


def problem(name: Column, value: Column) -> Column:
    """The first thing wrong with a header; null if nothing is."""
    return (
        F.when(F.lower(name).isin(*FORBIDDEN), "forbidden_name")
        .when(name == "", "empty_name")
        .when(~name.rlike(r"\A[A-Za-z0-9-]+\z"), "bad_name")
        .when(F.octet_length(value) > MAX_VALUE_BYTES, "value_too_long")
        .when(~value.rlike(r"\A[\x20-\x7E\t]*\z"), "bad_value")
    )


def problem_text(name: Column, value: Column) -> Column:
    """The message for :func:`problem`; null if nothing is wrong."""
    texts = F.create_map(*[F.lit(x) for pair in PROBLEM_TEXTS.items() for x in pair])
    out = F.try_element_at(texts, problem(name, value))
    for mark, by in (("%3", F.lit(str(MAX_VALUE_BYTES))), ("%2", F.octet_length(value).cast("string")), ("%1", name)):
        out = F.replace(out, F.lit(mark), by)
    return out


def overlay(*maps: Column) -> Column:
    """Maps of headers, later ones win; names are compared in canonical form."""
    def named(m: Column) -> Column:
        return F.transform_keys(m, lambda k, _: canonical(k))

    out = named(maps[0])
    for m in maps[1:]:
        out = F.map_zip_with(out, named(m), lambda _, low, high: F.coalesce(high, low))
    return out


def defaults() -> Column:
    return F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])


def is_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE))


def redacted(name: Column, value: Column) -> Column:
    """Bearer tokens keep their scheme, long secrets four characters at each end, short ones nothing."""
    return (
        F.when(~is_sensitive(name), value)
        .when(F.startswith(value, F.lit("Bearer ")), "Bearer ***")
        .when(F.octet_length(value) > 8, F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(4))))
        .otherwise("***")
    )


def redacted_map(headers: Column) -> Column:
    return F.transform_values(headers, redacted)


def redacted_text(headers: Column) -> Column:
    """``Name: value`` pairs, in order of names, joined by a comma."""
    pairs = F.transform(F.map_entries(redacted_map(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(pairs), ", ")
