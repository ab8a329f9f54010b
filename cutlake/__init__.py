"""cutlake: batch analytics and editing of media timelines as ordinary Spark plans."""

from cutlake.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
