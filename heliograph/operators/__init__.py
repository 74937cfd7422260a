"""DataFrame operators of a media and document library."""
