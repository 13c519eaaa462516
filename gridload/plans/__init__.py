"""Named queries over the test tables; importing ``catalogue`` registers them all."""
