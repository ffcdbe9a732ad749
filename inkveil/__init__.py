"""inkveil: find, redact, strip and encrypt sensitive data in Spark tables."""

from inkveil.config import (  # noqa: F401
    ALL_RULES,
    AnonymiseConfig,
    RuleSet,
    parse_keywords,
    rule_set,
    rules_from_switches,
)
from inkveil.functions.crypto import key_frame  # noqa: F401
from inkveil.functions.detect import luhn_valid, shannon_entropy  # noqa: F401
from inkveil.functions.spans import find_spans, redact, rule_counts  # noqa: F401
from inkveil.operators.encryption import decrypt_columns, encrypt_columns  # noqa: F401
from inkveil.operators.policy import diff, strip  # noqa: F401
from inkveil.operators.redaction import redact_columns, with_redaction  # noqa: F401
from inkveil.plans.batch import anonymise, anonymise_files, anonymise_packages, preview  # noqa: F401
