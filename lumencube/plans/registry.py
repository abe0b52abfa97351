"""All queries of the cube engine by name."""

from . import extras, images, more, stored
from .catalogue import CATALOGUE

__all__ = ["CATALOGUE", "extras", "images", "more", "stored"]
