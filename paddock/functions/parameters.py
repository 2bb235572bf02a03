"""Parameters of the two projects and the user's savings, read from JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from paddock.functions.scalars import clamp, leading_number, param_bool, param_int, param_string


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    required: bool
    default: object
    options: tuple[str, ...] = ()


# Parameters of the motorsport project in the order they are shown.
MOTORSPORT = (
    Parameter("mode", "select", True, "qualifying", ("qualifying", "race")),
    Parameter("source", "select", True, "fastf1", ("fastf1", "openf1")),
    Parameter("year", "int", True, 2026),
    Parameter("round_number", "int", True, 1),
    Parameter("train_seasons", "string", False, "auto"),
    Parameter("include_standings", "bool", False, False),
    Parameter("cache_dir", "string", False, ".cache/fastf1"),
    Parameter("meeting_name", "string", False, None),
    Parameter("country_name", "string", False, None),
)

# Parameters of the football project in the order they are shown.
FOOTBALL = (
    Parameter("mode", "select", True, "match_result", ("match_result", "scoreline")),
    Parameter("league", "string", True, "epl"),
    Parameter("season", "int", True, 2026),
    Parameter("round_number", "int", True, 1),
    Parameter("data_source", "string", False, "placeholder"),
    Parameter("train_seasons", "string", False, "auto"),
    Parameter("cache_dir", "string", False, None),
)

# Savings before a user has set any, with the largest allowed value.
SAVINGS = {
    "bankroll": (0.0, None),
    "monthlySavingsTarget": (0.0, None),
    "reserveBalance": (0.0, None),
    "defaultStake": (10.0, None),
    "maxStakePercent": (2.0, 100.0),
}
AUTO_SAVE_PROFIT = True


def typed(config: Column, parameter: Parameter) -> Column:
    """One parameter of a JSON object in its kind, the default where it is absent."""
    if parameter.kind == "int":
        return param_int(config, parameter.name, parameter.default)
    if parameter.kind == "bool":
        return param_bool(config, parameter.name, bool(parameter.default))
    return param_string(config, parameter.name, parameter.default if parameter.default is not None else "")


def typed_parameters(config: Column, parameters: tuple[Parameter, ...]) -> list[Column]:
    return [typed(config, p).alias(p.name) for p in parameters]


def rejections(config: Column, parameters: tuple[Parameter, ...]) -> Column:
    """What is wrong with a JSON object of parameters, in their order; an empty array accepts it.

    A required parameter may not be absent or empty, a number has to be one, and a choice has to be among its options.
    """

    def fault(p: Parameter) -> Column:
        text = F.get_json_object(config, f"$.{p.name}")
        given = F.coalesce(F.trim(text) != "", F.lit(False))
        wrong = F.lit(None).cast("string")
        if p.kind == "int":
            wrong = F.when(given & typed(config, p).isNull(), F.lit(f"{p.name} is not a number"))
        if p.kind == "select":
            wrong = F.when(given & ~text.isin(*p.options), F.lit(f"{p.name} is not one of {', '.join(p.options)}"))
        return F.when(~given & F.lit(p.required), F.lit(f"{p.name} is missing")).otherwise(wrong)

    return F.array_compact(F.array(*map(fault, parameters)))


def _number(document: Column, name: str) -> Column:
    """A JSON number as it is, a JSON text by its leading number; other kinds have none."""
    value = F.try_variant_get(document, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    numeric = (kind == "DOUBLE") | (kind == "BIGINT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, "$", "double")).otherwise(leading_number(text))


def savings(config: Column) -> list[Column]:
    """Savings with every field in range; a field that is no number takes its default."""
    document = F.try_parse_json(config)
    fields = [clamp(_number(document, n), d, 0.0, high).alias(n) for n, (d, high) in SAVINGS.items()]
    return [*fields, param_bool(config, "autoSaveProfit", AUTO_SAVE_PROFIT).alias("autoSaveProfit")]
