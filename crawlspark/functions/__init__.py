"""Scalar functions: Column builders, and the few Python ones that parse."""
