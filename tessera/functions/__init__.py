"""See the package README section for the operators kept here."""
