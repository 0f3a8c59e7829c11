"""Cache settings from INI or JSON files."""

from __future__ import annotations

import configparser
import dataclasses
import json

from pyspark.sql import SparkSession

from ..operators.cache import CacheConfig


def parse(text: str) -> CacheConfig:
    """Settings of a JSON object, or of all sections of an INI file; what isn't named keeps its default, an unknown name raises."""
    if text.lstrip().startswith("{"):
        given = json.loads(text)
    else:
        ini = configparser.ConfigParser()
        ini.read_string(text)
        given = {k: v for section in ini.sections() for k, v in ini[section].items()}
    kinds = {f.name: type(f.default) for f in dataclasses.fields(CacheConfig)}
    if unknown := sorted(set(given) - set(kinds)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return CacheConfig(**{k: _value(v, kinds[k]) for k, v in given.items()})


def _value(v: object, kind: type) -> object:
    if kind is bool and isinstance(v, str):
        if v.lower() not in configparser.ConfigParser.BOOLEAN_STATES:
            raise ValueError(f"not a boolean: {v!r}")
        return configparser.ConfigParser.BOOLEAN_STATES[v.lower()]
    return kind(v)


def load(spark: SparkSession, path: str) -> CacheConfig:
    """Settings of a file in any store that Spark reads."""
    return parse(spark.read.text(path, wholetext=True).first().value)
