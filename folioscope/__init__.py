"""Document-inventory and size-reduction analytics on PySpark."""
