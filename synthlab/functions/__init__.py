"""Column-level helpers (JVM-side expressions only)."""
from synthlab.functions.keys import (  # noqa: F401
    hash_hex, hash_uniform, hash_normal, hash_bucket, uniform_from_hex,
)
from synthlab.functions.tdist import t_two_sided_p, t_cdf, t_crit  # noqa: F401
