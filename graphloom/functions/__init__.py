"""RDF terms and SPARQL expressions."""
