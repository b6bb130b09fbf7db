"""Views that read standard tables as sequencing data, and the catalogue of queries over them with their SQL."""
