import sys

from codelode.api import main

sys.exit(main(sys.argv[1:]))
