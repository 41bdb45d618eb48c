"""rolevec: behaviour-sequence vectors and two-round clustering on Spark."""

from rolevec import defaults
from rolevec.session import checkpoint_dir, local_session, scratch_path

__all__ = ["checkpoint_dir", "defaults", "local_session", "scratch_path"]
__version__ = "0.1.0"
