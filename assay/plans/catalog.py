"""Imports every query module so the registry is complete."""

from assay.plans import q_features  # noqa: F401
from assay.plans.registry import ORACLES, QUERIES  # noqa: F401
from assay.plans import q_clean  # noqa: F401,E402
from assay.plans import q_encode  # noqa: F401,E402
from assay.plans import q_profile  # noqa: F401,E402
from assay.plans import q_sampling  # noqa: F401,E402
from assay.plans import q_eval  # noqa: F401,E402
from assay.plans import q_select  # noqa: F401,E402
from assay.plans import q_neighbors  # noqa: F401,E402
from assay.plans import q_models  # noqa: F401,E402
from assay.plans import q_misc  # noqa: F401,E402
from assay.plans import analysis  # noqa: F401,E402
