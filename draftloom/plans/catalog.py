"""All registered queries. Importing the modules fills the register."""

from draftloom.plans import drawing_queries, geometry_queries, matching_queries, model_queries, publish_queries, recognition_queries, text_queries, wall_queries  # noqa: F401
from draftloom.plans.registry import CHECKS, COVERS, QUERIES  # noqa: F401
