"""IRIs of the W3C vocabularies, as canonical N-Triples terms."""

# fixed values: the namespaces of the W3C
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def rdf(name: str) -> str:
    return f"<{RDF}{name}>"


def rdfs(name: str) -> str:
    return f"<{RDFS}{name}>"


def owl(name: str) -> str:
    return f"<{OWL}{name}>"


def xsd(name: str) -> str:
    return f"<{XSD}{name}>"


TYPE, FIRST, REST, NIL = rdf("type"), rdf("first"), rdf("rest"), rdf("nil")
THING, NOTHING, CLASS, SAME = owl("Thing"), owl("Nothing"), owl("Class"), owl("sameAs")
# an internal relation: the members of lists; it is never part of a closure
MEMBER = "<urn:axiomill:listMember>"
SEEDS = ((THING, TYPE, CLASS), (NOTHING, TYPE, CLASS))
