"""All query modules of the library."""

from starloom.plans import annotate, diagnosis, files, further, images, indexes, more, outputs, scalars, solving, sources, spatial, streams, tables, tiled, web  # noqa: F401
from starloom.plans.registry import QUERIES, SQL  # noqa: F401
