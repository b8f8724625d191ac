"""The declarative configuration: fields, encoders, cohorts and models, read from YAML."""

from dataclasses import dataclass, field

from outlyr import extensions

# Field types, and the encoder that each model takes for a type where none is named.
TYPES = ("timestamp", "numeric", "boolean", "str_categorical", "str_identifier", "str_text", "ip_address", "semver", "json_expand", "ignore")
DEFAULT_ENCODERS = {
    "HalfSpaceTrees": {"numeric": "StandardScaler", "boolean": "PassThrough", "str_categorical": "OneHotEncoder", "str_identifier": "OneHotHashEncoder", "str_text": "NotSupported"},
    "Autoencoder": {"numeric": "StandardScaler", "boolean": "PassThrough", "str_categorical": "LabelIndex", "str_identifier": "HashIndex", "str_text": "Drain3Encoder"},
    "NoOp": {"numeric": "NoOp", "boolean": "NoOp", "str_categorical": "NoOp", "str_identifier": "NoOp", "str_text": "SentenceTransformerEncoder"},
}
ENCODERS = ("StandardScaler", "MinMaxScaler", "FrequencyEncoder", "LabelIndex", "HashIndex", "OneHotEncoder", "OneHotHashEncoder", "PassThrough", "NoOp", "Drain3Encoder", "SentenceTransformerEncoder")


@dataclass(frozen=True)
class Field:
    type: str
    encoder: str | None = None
    params: dict = field(default_factory=dict)
    source: str | None = None


@dataclass(frozen=True)
class Cohort:
    name: str
    fields: tuple[str, ...] = ()
    weight: float = 1.0
    model: str = "HalfSpaceTrees"
    features: str = "default"
    params: dict = field(default_factory=dict)
    warmup: int = 0
    lru_size: int | None = None  #: no state is evicted; but ids that such a cohort gives while it scores are not kept


@dataclass(frozen=True)
class Config:
    features: dict[str, dict[str, Field]]
    cohorts: tuple[Cohort, ...]
    identifiers: tuple[str, ...] = ()
    database: dict = field(default_factory=lambda: {"type": "memory"})  #: type and path; a path is where the state table lies
    dump_results: bool = False  #: whether inputs and responses are written as JSON beside the results


MODELS = ("HalfSpaceTrees", "Autoencoder", "NoOp")
#: The set of features of a cohort that names none.
NO_FEATURES = ""


def encoder_of(f: Field, model: str) -> str:
    """The named encoder, or the model's for the type; ValueError for an unknown or unsupported one."""
    defaults = DEFAULT_ENCODERS[model] if model in DEFAULT_ENCODERS else extensions.MODELS[model].encoders
    name = f.encoder or defaults.get(f.type, "PassThrough")
    if name not in ENCODERS and name not in extensions.ENCODERS:
        raise ValueError(f"Unknown preprocessor: '{name}'")
    return name


def _named(raw: str | dict) -> tuple[str, dict]:
    """A name, or a name (also called type) with params, which may stand beside it."""
    if isinstance(raw, str):
        return raw, {}
    own = {k: v for k, v in raw.items() if k not in ("name", "type", "params")}
    return raw.get("name", raw.get("type")), own | (raw.get("params") or {})


def _field(raw: str | dict) -> Field:
    if isinstance(raw, str):
        return Field(raw)
    name, params = (None, {}) if raw.get("preprocessor") is None else _named(raw["preprocessor"])
    return Field(raw["type"], name, params, raw.get("source"))


def parse(raw: dict) -> Config:
    """A configuration from a parsed YAML document. Order is kept: aliases and overrides see earlier entries only."""
    features = {name: {k: _field(v) for k, v in (fields or {}).items()} for name, fields in (raw.get("features") or {}).items()}
    cohorts = []
    for c in raw.get("cohorts") or ():
        kind, params = _named(c.get("model", "HalfSpaceTrees"))
        if kind not in MODELS and kind not in extensions.MODELS:
            raise ValueError(f"Unknown model: '{kind}'. Available: {[*MODELS, *extensions.MODELS]}")
        name = c["features_config"] if "features_config" in c else c.get("features", "default")
        if name is None:
            name = NO_FEATURES
            features.setdefault(name, {})
        elif name not in features:
            raise ValueError(f"Cohort '{c['name']}' references unknown features_config '{name}'. Available: {list(features)}")
        # A warm-up counts for the cohort wherever it is given.
        warmup = c.get("warmup_count") if c.get("warmup_count") is not None else params.get("warmup_count", 0) if kind != "Autoencoder" else 0
        cohorts.append(Cohort(c["name"], tuple(c.get("fields") or ()), float(c.get("weight", 1.0)), kind, name, params, int(warmup or 0), c.get("lru_size")))
    debug = raw.get("debug") or {}
    return Config(features, tuple(cohorts), tuple(raw.get("identifiers") or ()), dict(raw.get("database") or {"type": "memory"}), bool(debug.get("dump_results", False)))


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return parse(yaml.safe_load(f))
