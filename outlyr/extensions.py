"""Extension points: encoders and models of one's own, named in a configuration like those of the library.

Both are plans over DataFrames, used alike by Engine and by Service, and so by streams. What they learn is a state for each
key, a MAP of numbers by name, made of the state before and of new rows; Service stores it with the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

State = DataFrame  #: key, state (MAP<STRING, DOUBLE>), one row for each key


@dataclass(frozen=True)
class Encoder:
    """encode(df, column, out, params, before) gives df with the columns that it names, which begin with out.

    df holds key, phase (0: learned, 1: scored with the state after all that is learned) and seq, the order of arrival.
    fit(rows, column, params, before) gives the state after rows, for the keys of rows. Values outside limits are refused.
    """

    encode: Callable[[DataFrame, str, str, dict, State | None], tuple[DataFrame, list[str]]]
    fit: Callable[[DataFrame, str, dict, State | None], State] | None = None
    limits: tuple[float, float] | None = None


@dataclass(frozen=True)
class Model:
    """fit(rows, params, before) gives the state after rows of key, phase, seq, features (ARRAY<DOUBLE>).

    score(rows, state, params) gives rows with anomaly_score, from 0 to 100, or NULL for a key that has no state.
    encoders: the encoder of each type of field where a configuration names none.
    """

    fit: Callable[[DataFrame, dict, State | None], State]
    score: Callable[[DataFrame, State, dict], DataFrame]
    encoders: dict[str, str] = field(default_factory=lambda: {"numeric": "StandardScaler", "boolean": "PassThrough"})


ENCODERS: dict[str, Encoder] = {}
MODELS: dict[str, Model] = {}


def register_encoder(name: str, encoder: Encoder) -> None:
    ENCODERS[name] = encoder


def register_model(name: str, model: Model) -> None:
    MODELS[name] = model
