"""maskara: instance-annotation analytics expressed as Spark plans."""
