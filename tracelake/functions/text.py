"""Names, call stacks, numbers and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers that profilers write into names and frames.
KERNEL_PREFIX = "triton_"
MODULE_MARK = "nn.Module:"
OBJECT_ADDRESS = r" object at 0x[0-9a-fA-F]+"
FRAME_SEPARATOR = " -> "


def strip_kernel_suffix(name: Column) -> Column:
    """A generated kernel name without its running number; names of fewer than four parts stay."""
    generated = name.startswith(KERNEL_PREFIX) & (F.size(F.split(name, "_")) >= 4)
    return F.when(generated, F.regexp_replace(name, r"_\d+\z", "")).otherwise(name)


def strip_module_suffix(name: Column) -> Column:
    """A module name without its last _number, removed once."""
    return F.regexp_replace(name, r"^(.+)_\d+$", "$1")


def normalize_stack(stack: Column, coarse: bool = False) -> Column:
    """Module frames alone where there are any (without numbers if coarse); else all frames without object addresses.

    A null stack becomes an empty one.
    """

    def module(frame: Column) -> Column:
        bare = F.replace(frame, F.lit(f"{MODULE_MARK} "), F.lit(""))
        return strip_module_suffix(bare) if coarse else bare

    modules = F.filter(stack, lambda f: f.contains(MODULE_MARK))
    plain = F.transform(stack, lambda f: F.regexp_replace(f, OBJECT_ADDRESS, ""))
    out = F.when(F.size(modules) > 0, F.transform(modules, module)).otherwise(plain)
    return F.coalesce(out, F.array().cast("array<string>"))


def phase(stack: Column) -> Column:
    """fwd, bwd or grad by the first frame from the root that tells; none if no frame does."""
    told = F.transform(
        stack,
        lambda f: F.when(f.contains(": forward"), "fwd").when(f.contains(": backward") | f.contains("Backward"), "bwd").when(f.contains("Grad"), "grad"),
    )
    return F.coalesce(F.try_element_at(F.filter(told, lambda c: c.isNotNull()), F.lit(1)), F.lit("none"))


def stack_text(stack: Column) -> Column:
    return F.array_join(stack, FRAME_SEPARATOR)


def tuple_text(stack: Column) -> Column:
    """A stack as a parenthesised, quoted list; the order of these texts decides between stacks."""
    quoted = F.array_join(F.transform(stack, lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", ")
    return F.concat(F.lit("("), quoted, F.when(F.size(stack) == 1, ",)").otherwise(")"))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)


def change_text(ratio: Column) -> Column:
    """A ratio of means as a signed percentage: 0.8 is 20.0%, 1.2 is -20.0%."""
    return F.when(ratio < 1, F.format_string("%.1f%%", (1 - ratio) * 100)).otherwise(F.format_string("-%.1f%%", (ratio - 1) * 100))


def url_last_part(url: Column) -> Column:
    """The decoded last part of the path of a URL."""
    path = F.try_url_decode(F.parse_url(url, F.lit("PATH")))
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def url_parameter(url: Column, key: str) -> Column:
    return F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(key)))
