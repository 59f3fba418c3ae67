"""A Spark-native knowledge-graph engine."""

from lattica.ontology import DEFAULT, Ontology
from lattica.schema import DOCUMENT, EDGE, NODE, Graph
from lattica.session import session

__version__ = "0.2.0"
__all__ = ["DEFAULT", "DOCUMENT", "EDGE", "NODE", "Graph", "Ontology", "__version__", "session"]
