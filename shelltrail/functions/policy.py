"""The environment privacy policy, and its translation into column expressions.

A policy is small configuration on the driver. It decides by variable *name*:
drop the variable, keep a short hash of its value, or keep the value.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, SparkSession, functions as F

DENY = "deny"
NOT_ALLOWED = "not_allowed"
HASH = "hash"
PLAIN = "plain"

HASHED_VALUE = r"^h8_[a-f0-9]{8}$"

# --- Fixed values: the default lists. Results must equal these exactly. ---

ALLOWED_NAMES = [
    "PWD", "OLDPWD", "USER", "HOME", "SHELL", "LANG", "LC_ALL", "TZ", "EDITOR", "PAGER", "BROWSER", "TMPDIR",
    "XDG_CONFIG_HOME", "XDG_DATA_HOME", "XDG_CACHE_HOME", "NODE_ENV", "RAILS_ENV", "DJANGO_SETTINGS_MODULE",
    "FLASK_ENV", "ENVIRONMENT", "ENV", "STAGE", "DEPLOY_ENV", "RBENV_VERSION", "PYENV_VERSION", "NVM_CURRENT",
    "JAVA_HOME", "GOPATH", "GOROOT", "CARGO_HOME", "RUSTUP_HOME", "AWS_PROFILE", "AWS_REGION", "GOOGLE_CLOUD_PROJECT",
    "AZURE_RESOURCE_GROUP", "DOCKER_HOST", "KUBERNETES_NAMESPACE", "KUBECTL_CONTEXT", "CI", "GITHUB_ACTIONS",
    "JENKINS_URL", "GITLAB_CI", "TRAVIS", "CIRCLECI",
]

ALLOWED_PATTERNS = [
    r"^[A-Z_]+_ENV$", r"^[A-Z_]+_ENVIRONMENT$", r"^[A-Z_]+_STAGE$", r"^[A-Z_]+_PROFILE$", r"^[A-Z_]+_NAMESPACE$",
    r"^[A-Z_]+_CLUSTER$", r"^[A-Z_]+_REGION$", r"^[A-Z_]+_ZONE$", r"^[A-Z_]+_BRANCH$", r"^[A-Z_]+_VERSION$",
    r"^[A-Z_]+_PATH$", r"^[A-Z_]+_HOME$", r"^[A-Z_]+_ROOT$", r"^[A-Z_]+_CONFIG$", r"^[A-Z_]+_URL$", r"^[A-Z_]+_HOST$",
    r"^[A-Z_]+_PORT$", r"^[A-Z_]+_KEY$", r"^GIT_", r"^DOCKER_", r"^K8S_", r"^KUBE_", r"^HELM_", r"^TERRAFORM_",
]

DENIED_NAMES = [
    "_", "PS1", "PS2", "PS3", "PS4", "TERM", "LINES", "COLUMNS", "HISTFILE", "HISTSIZE", "HISTCONTROL",
    "HISTTIMEFORMAT", "IFS", "OPTIND", "OPTARG", "OPTERR", "RANDOM", "SECONDS", "BASH_VERSINFO", "BASH_VERSION",
    "BASH_ARGC", "BASH_ARGV", "BASH_ARGV0", "BASH_COMMAND", "BASH_EXECUTION_STRING", "BASH_LINENO", "BASH_SOURCE",
    "BASH_SUBSHELL", "FUNCNAME", "BASH_REMATCH", "PIPESTATUS", "REPLY", "SHELLOPTS", "BASHOPTS",
]

# Names that no configuration can let through.
ABSOLUTE_DENY = [
    r"^___PREEXEC_", r"^__", r"^BASH_FUNC_", r"^_$", r"^PS[1-4]$", r"^TERM$", r"^LINES$", r"^COLUMNS$", r"^HIST",
    r"^IFS$", r"^OPT", r"^RANDOM$", r"^SECONDS$", r"^BASH_", r"^FUNCNAME$", r"^PIPESTATUS$", r"^REPLY$",
    r"^SHELLOPTS$", r"^BASHOPTS$",
]

HASH_PATTERNS = [
    r"(?i)password", r"(?i)secret", r"(?i)key", r"(?i)token", r"(?i)auth", r"(?i)credential", r"(?i)private",
    r"(?i)session", r"(?i)cookie", r"(?i)cert", r"(?i)ssl", r"(?i)tls", r"(?i)oauth", r"(?i)jwt", r"(?i)bearer",
    r"(?i)access", r"(?i)refresh", r"(?i)salt", r"(?i)hash", r"(?i)signature", r"(?i)license", r"(?i)serial",
]

# The built-in check; it covers what may carry credentials inside as well.
BUILT_IN_SENSITIVE = [
    r"(?i)password", r"(?i)secret", r"(?i)key", r"(?i)token", r"(?i)auth", r"(?i)credential", r"(?i)private",
    r"(?i)session", r"(?i)cookie", r"(?i)cert", r"(?i)ssl", r"(?i)tls", r"(?i)oauth", r"(?i)jwt", r"(?i)bearer",
    r"(?i)access", r"(?i)refresh", r"(?i)salt", r"(?i)hash", r"(?i)signature", r"(?i)license", r"(?i)serial",
    r"(?i)url", r"(?i)dsn", r"(?i)connection", r"(?i)endpoint",
]

# Entries the capture hook leaves out before anything else looks at them.
CAPTURE_NOISE = r"^(___PREEXEC_|_=|PS1=|PS2=|BASH_|FUNCNAME=|PIPESTATUS=)"

# --- End of fixed values. ---


@dataclass(frozen=True)
class EnvPolicy:
    """Which variables to keep. The default is the stock policy.

    ``own_names`` are unanchored patterns for a capture tool's private
    variables; they are denied outright, like ``ABSOLUTE_DENY``.
    """

    allow_names: tuple[str, ...] = tuple(ALLOWED_NAMES)
    allow_patterns: tuple[str, ...] = tuple(ALLOWED_PATTERNS)
    deny_names: tuple[str, ...] = tuple(DENIED_NAMES)
    hash_patterns: tuple[str, ...] = tuple(HASH_PATTERNS)
    hash_sensitive_values: bool = True
    absolute_deny: tuple[str, ...] = tuple(ABSOLUTE_DENY)
    built_in_sensitive: tuple[str, ...] = tuple(BUILT_IN_SENSITIVE)
    own_names: tuple[str, ...] = ()
    allow_everything: bool = False
    version: str = "unknown"

    @staticmethod
    def from_json(text: str) -> EnvPolicy:
        """Reads a configuration; what it leaves out is empty, not the default."""
        config = json.loads(text)
        if not isinstance(config, dict):
            raise ValueError("an environment policy must be a JSON object")
        allow, deny = config.get("allowlist") or {}, config.get("denylist") or {}
        return EnvPolicy(
            allow_names=tuple(allow.get("exact") or ()),
            allow_patterns=tuple(allow.get("patterns") or ()),
            deny_names=tuple(deny.get("exact") or ()),
            hash_patterns=tuple(deny.get("patterns") or ()),
            hash_sensitive_values=bool(config.get("hash_sensitive_values", False)),
            version=str(config.get("version", "unknown")),
        )

    @staticmethod
    def load(path: str | None = None, search: Iterable[str] = ()) -> EnvPolicy:
        """An explicit ``path`` must parse. Places to ``search`` are tried in turn, else the default."""
        if path:
            with open(path, encoding="utf-8") as handle:
                return EnvPolicy.from_json(handle.read())
        for place in search:
            try:
                with open(os.path.expanduser(place), encoding="utf-8") as handle:
                    return EnvPolicy.from_json(handle.read())
            except (OSError, ValueError):
                continue
        return EnvPolicy()

    def to_json(self) -> str:
        return json.dumps(
            {
                "version": self.version,
                "allowlist": {"exact": list(self.allow_names), "patterns": list(self.allow_patterns)},
                "denylist": {"exact": list(self.deny_names), "patterns": list(self.hash_patterns)},
                "hash_sensitive_values": self.hash_sensitive_values,
            },
            indent=2,
        )

    def check(self, spark: SparkSession) -> EnvPolicy:
        """Raises for a pattern that cannot be compiled, naming it."""
        for pattern in (*self.allow_patterns, *self.hash_patterns, *self.absolute_deny, *self.own_names):
            try:
                spark.range(1).select(F.col("id").cast("string").rlike(pattern)).collect()
            except Exception as error:
                raise ValueError(f"the policy pattern {pattern!r} is not a regular expression") from error
        return self

    def with_plain_urls(self) -> EnvPolicy:
        return replace(self, hash_sensitive_values=False)

    # -- column expressions; each list becomes one alternation --

    def denied(self, name: Column) -> Column:
        return _matches(name, (*self.absolute_deny, *self.own_names)) | _one_of(name, self.deny_names)

    def allowed(self, name: Column) -> Column:
        if self.allow_everything:
            return F.lit(True)
        return _one_of(name, self.allow_names) | _matches(name, self.allow_patterns)

    def sensitive(self, name: Column) -> Column:
        return _matches(name, self._sensitive_patterns())

    def verdict(self, name: Column) -> Column:
        return (
            F.when(self.denied(name), DENY)
            .when(~self.allowed(name), NOT_ALLOWED)
            .when(self.sensitive(name), HASH)
            .otherwise(PLAIN)
        )

    def masked_value(self, name: Column, value: Column, keep_hashed: bool = False) -> Column:
        """The value to store, or null for a variable that is not kept."""
        hashed = hash_value(value)
        if keep_hashed:
            hashed = F.when(value.rlike(HASHED_VALUE), value).otherwise(hashed)
        # Listed names are most of every environment, so their verdicts come first, from a set.
        listed, dropped = self._listed(), F.lit(None).cast("string")
        return (
            F.when(_one_of(name, listed[PLAIN]), value)
            .when(_one_of(name, listed[HASH]), hashed)
            .when(_one_of(name, self.deny_names), dropped)
            .when(~self.allowed(name) | self.denied(name), dropped)
            .when(self.sensitive(name), hashed)
            .otherwise(value)
        )

    def masked(self, env: Column, keep_hashed: bool = False) -> Column:
        """The environment under this policy; null when nothing is left of it."""
        entries = F.filter(
            F.transform(
                F.map_entries(env),
                lambda entry: F.struct(
                    entry["key"].alias("key"),
                    self.masked_value(entry["key"], entry["value"], keep_hashed).alias("value"),
                ),
            ),
            lambda entry: entry["value"].isNotNull(),
        )
        # A list of one, so that the entries are worked out once and not for each mention.
        return F.transform(
            F.array(entries), lambda kept: F.when(F.size(kept) > 0, F.map_from_entries(kept))
        )[0]

    def _sensitive_patterns(self) -> tuple[str, ...]:
        patterns = dict.fromkeys(self.hash_patterns)
        if self.hash_sensitive_values:
            patterns.update(dict.fromkeys(self.built_in_sensitive))
        return tuple(patterns)

    def _listed(self) -> dict[str, tuple[str, ...]]:
        """The allowed names with a known verdict. Empty where a pattern means nothing to this side."""
        try:
            deny = [re.compile(pattern) for pattern in (*self.absolute_deny, *self.own_names)]
            sensitive = [re.compile(pattern) for pattern in self._sensitive_patterns()]
        except re.error:
            return {PLAIN: (), HASH: ()}
        kept = [
            name
            for name in self.allow_names
            if name not in self.deny_names and not any(pattern.search(name) for pattern in deny)
        ]
        hashed = tuple(name for name in kept if any(pattern.search(name) for pattern in sensitive))
        return {PLAIN: tuple(name for name in kept if name not in hashed), HASH: hashed}


# The older, narrower rule: nothing is dropped, three words are hashed.
SIMPLE_POLICY = EnvPolicy(
    allow_names=(),
    allow_patterns=(),
    deny_names=(),
    hash_patterns=("(?i)secret", "(?i)password", "(?i)key"),
    hash_sensitive_values=False,
    absolute_deny=(),
    allow_everything=True,
)


def hash_value(value: Column) -> Column:
    return F.concat(F.lit("h8_"), F.substring(F.sha2(value, 256), 1, 8))


def is_hashed(value: Column) -> Column:
    return value.startswith("h8_")


def without_capture_noise(entries: Column) -> Column:
    return F.filter(entries, lambda entry: ~entry.rlike(CAPTURE_NOISE))


def env_from_entries(entries: Column) -> Column:
    """``K=V`` entries as a map: split at the first ``=``, no ``=`` drops the entry, the last duplicate wins."""
    pairs = F.filter(F.transform(entries, lambda entry: F.split(entry, "=", 2)), lambda pair: F.size(pair) == 2)
    return F.map_from_entries(
        F.transform(pairs, lambda pair: F.struct(pair[0].alias("key"), pair[1].alias("value")))
    )


def _matches(name: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found in the name. Those tied to its start share one anchor."""
    anchored = [pattern[1:] for pattern in patterns if pattern.startswith("^") and "|" not in pattern]
    loose = [pattern for pattern in patterns if not (pattern.startswith("^") and "|" not in pattern)]
    parts = []
    if anchored:
        parts.append("^(?:" + "|".join(f"(?:{pattern})" for pattern in anchored) + ")")
    if loose:
        parts.append("|".join(f"(?:{pattern})" for pattern in loose))
    if not parts:
        return F.lit(False)
    found = name.rlike(parts[0])
    return found | name.rlike(parts[1]) if len(parts) > 1 else found


def _one_of(name: Column, names: tuple[str, ...]) -> Column:
    return name.isin(*names) if names else F.lit(False)
