"""Column expressions that classify environment values and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The value classes and the limits beyond which a value is stored but not searchable.
HASHED = r"^h8_[a-f0-9]{8}$"
PATH = r"^(/[^\s]*|[A-Z]:\\[^\s]*)$"
URL = r"^https?://.*"
VERSION = r"^\d+\.\d+(\.\d+)?"
BOOLEAN = r"^(true|false|1|0|yes|no|on|off)$"
NUMBER = r"^[+-]?\d+$"
NOISE_NAME = r"(HIST|LESS|LS_COLORS|TERM|COLORTERM|LANG|LC_)"
SEARCH_LIMITS = {"hashed": 32, "path": 512, "url": 256, "default": 256}
COLUMN_LIMITS = {"command": 1024, "pwd": 512, "hostname": 256}
SUGGESTED_NAME = r"(ENV|PROFILE|KEY|URL|HOST|PORT)$"


def value_class(value: Column, mode: str = "basic") -> Column:
    """``basic`` is the drift monitor's scheme, ``extended`` the storage template's."""
    if mode == "basic":
        return (
            F.when(value.isNull(), "unknown")
            .when(value.startswith("h8_"), "hashed")
            .when(value.startswith("/"), "path")
            .when(value.rlike(URL), "url")
            .otherwise("string")
        )
    if mode == "extended":
        return (
            F.when(value.rlike(HASHED), "hashed")
            .when(value.rlike(PATH), "path")
            .when(value.rlike(URL), "url")
            .when(value.rlike(VERSION), "version")
            .when(value.rlike(BOOLEAN), "boolean")
            .when(value.rlike(NUMBER), "number")
            .otherwise("default")
        )
    raise ValueError(f"unknown value classes: {mode}")


def search_limit(value: Column) -> Column:
    """The longest searchable value of its class; classes without a limit give null."""
    kind = value_class(value, "extended")
    limit = F.when(kind == "default", SEARCH_LIMITS["default"])
    for name in ("hashed", "path", "url"):
        limit = limit.when(kind == name, SEARCH_LIMITS[name])
    return limit


def name_policy(name: Column) -> dict[str, Column]:
    """How a variable of this name would be stored: longest value, indexed or not."""
    location = name.rlike(r"_(URL|DSN|ENDPOINT)$")
    folder = name.rlike(r"_(PATH|HOME|ROOT)$") | name.isin("PWD", "OLDPWD")
    stage = name.rlike(r"_(ENV|ENVIRONMENT|STAGE)$")
    return {
        "ignore_above": F.when(location | folder, 512).when(stage, 32).otherwise(256),
        "indexed": ~(location | name.rlike(NOISE_NAME)),
    }
