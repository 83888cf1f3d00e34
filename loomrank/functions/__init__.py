"""Part of loomrank; see the modules."""
